"""Pluggable responder (F2): the model call as a ``mapInPandas`` stage.

The caller supplies ``call(query: str) -> str``. Requests are spread
over ``parallelism`` partitions (the bound on concurrent calls), each
partition handles Arrow batches of requests, and failures are kept as
data in a separate ``error`` column instead of being mixed into the
response text. A responder is lazy: each action calls the model again. The
stages that take one (``suites.judge``, ``modes.multi_turn``) therefore hand
its call to an ``answers.AnswerTable``, which asks every request once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.plans.answers import Call

RESPONSE_FIELDS = "response string, error string"


def make_responder(call: Callable[[str], str], parallelism: int | None = None,
                   key: str = "request_id", query: str = "query") -> Callable[[DataFrame], DataFrame]:
    def run(batches):
        for pdf in batches:
            out, err = [], []
            for q in pdf[query]:
                try:
                    out.append(call(q))
                    err.append(None)
                except Exception as e:  # errors are data, not response text
                    out.append(None)
                    err.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"request_id": pdf[key], "response": out, "error": err})

    def respond(requests: DataFrame) -> DataFrame:
        req = requests.select(F.col(key).alias(key), F.col(query).alias(query))
        if parallelism:
            req = req.repartition(parallelism, key)
        kind = requests.schema[key].dataType.simpleString()          # any id type
        return req.mapInPandas(run, f"request_id {kind}, {RESPONSE_FIELDS}")

    respond.model = Call(call, parallelism)
    return respond


def recorded(answers: DataFrame, key: str = "request_id", response: str = "response") -> Callable[[DataFrame], DataFrame]:
    """A responder that looks answers up in a table instead of calling a model."""
    kept = answers.select(F.col(key).alias("request_id"), F.col(response).alias("response"))

    def respond(requests: DataFrame) -> DataFrame:
        return requests.select("request_id").join(kept, "request_id")

    return respond


# Ship this module's functions by value: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
