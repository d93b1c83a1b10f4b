"""Stored model answers: every request is asked once.

An ``AnswerTable`` is a folder of Parquet files keyed by request. ``ask``
leaves out the requests whose answer it holds, asks a model for the rest and
returns the answers from the table, so later actions, later runs and a
restart read what was paid for.

A model that is a Python call answers inside tasks, which write answers in
small files as they come: a file is written under a hidden name and
renamed, so it is there whole or not at all. A task that is tried again,
after an error or on another executor, first reads the files that earlier
attempts of it left and asks for the rest only; a job that fails as a whole
leaves its files to the next run. At most the answers of one unfinished file
are asked twice; speculative execution, which runs a task twice on purpose,
should be off for such jobs.

A request is its key and its text: if the text of a key changes, it is asked
anew. Errors are answers with a null response; they count as stored unless
``retry_errors`` is set. Requests without a key or a text (null) are not asked
and have no row.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.sources import shared
from evalspark.session import scratch_path

#: Answers of a file, at most, and seconds after which a file is closed.
FILE_ANSWERS = 256
FILE_SECONDS = 20.0


class Call:
    """A model as a Python call, for ``AnswerTable.ask`` or as a plain responder.

    ``parallelism`` tasks call it side by side (the bound on concurrent calls).
    """

    def __init__(self, call: Callable[[str], str], parallelism: int | None = None):
        self.call = call
        self.parallelism = parallelism


def _asker(call: Callable[[str], str], folder: str, key: str, open_folder=shared.file_system,
           most: int = FILE_ANSWERS, seconds: float = FILE_SECONDS):
    """A function of a task's batches that asks, writes answers as they come and
    returns their number. It is shipped by value, so it imports what it uses."""

    def run(batches):
        import time

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs as pfs
        from pyspark import TaskContext

        task = TaskContext.get()
        mine = f"part-{task.partitionId():06d}-"
        store, top = open_folder(folder)
        known = set()
        for info in store.get_file_info(pfs.FileSelector(top, allow_not_found=True)):
            if info.base_name.startswith(mine):  # of an earlier attempt
                table = pq.read_table(info.path, columns=[key, "query_hash"], filesystem=store)
                known.update(zip(table[key].to_pylist(), table["query_hash"].to_pylist()))
        held, asked, files, since = [], 0, 0, time.monotonic()
        schema = None

        def flush():
            nonlocal files, since
            if held:
                name = f"{mine}{task.taskAttemptId()}-{files}.parquet"
                pq.write_table(pa.Table.from_pylist(held, schema), f"{top}/.{name}", filesystem=store)
                store.move(f"{top}/.{name}", f"{top}/{name}")
                files += 1
                held.clear()
            since = time.monotonic()

        for batch in batches:
            if schema is None:
                schema = pa.schema([batch.schema.field(key), ("query_hash", pa.int64()),
                                    ("response", pa.string()), ("error", pa.string()), ("at", pa.int64())])
            for row in batch.select([key, "query_hash", "query"]).to_pylist():
                if (row[key], row["query_hash"]) in known:
                    continue
                answer = {key: row[key], "query_hash": row["query_hash"], "response": None, "error": None}
                try:
                    answer["response"] = call(row["query"])
                except Exception as e:  # an error is data, not a response's text
                    answer["error"] = f"{type(e).__name__}: {e}"
                held.append(answer | {"at": time.time_ns() // 1000})
                asked += 1
                if len(held) >= most or time.monotonic() - since > seconds:
                    flush()
        flush()
        yield pa.RecordBatch.from_pydict({"asked": pa.array([asked], pa.int64())})

    return run


class AnswerTable:
    """Answers of one model, stored by request key."""

    def __init__(self, spark: SparkSession, path: str | None = None, key: str = "request_id",
                 retry_errors: bool = False, file_answers: int = FILE_ANSWERS):
        self.spark, self.key, self.retry_errors = spark, key, retry_errors
        self.path = path or scratch_path(spark, f"answers-{uuid.uuid4().hex}")
        self.file_answers = file_answers
        self.asked = 0          # requests handed to the model through this object
        shared.make_folder(spark, self.path)

    def _rows(self, key_type: str) -> DataFrame:
        schema = f"`{self.key}` {key_type}, query_hash bigint, response string, error string, at bigint"
        # The runs are named one by one: to Spark two scans of one folder are the same
        # scan, whatever was added to it between them, and it would run one for both.
        runs = shared.folders(self.spark, self.path)
        return self.spark.read.schema(schema).parquet(*runs) if runs else self.spark.createDataFrame([], schema)

    def read(self, key_type: str) -> DataFrame:
        """key, query_hash, response, error: one row a request, without error if any has none."""
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "response", "error")).alias("a")
        return self._rows(key_type).groupBy(self.key, "query_hash").agg(best).select(
            self.key, "query_hash", "a.response", "a.error")

    def latest(self, key_type: str) -> DataFrame:
        """key, response, error: the last answer of each key, whatever its text; one without error goes before."""
        last = F.max(F.struct(F.col("error").isNull().alias("good"), "at", "response", "error")).alias("a")
        return self._rows(key_type).groupBy(self.key).agg(last).select(self.key, "a.response", "a.error")

    def ask(self, requests: DataFrame, model: Call | Callable[[DataFrame], DataFrame],
            query: str = "query") -> DataFrame:
        """key, response, error of every request, after the missing ones are asked.

        Runs at once. ``model`` is a ``Call``, or a function from a table of
        requests (key, query) to one of answers (key, response, perhaps error).
        Of several texts for one key the one with the smallest hash is asked.
        """
        kind = requests.schema[self.key].dataType.simpleString()
        rows = requests.where(F.col(query).isNotNull() & F.col(self.key).isNotNull()).select(
            self.key, F.xxhash64(query).alias("query_hash"), F.col(query).alias("query"))
        one = rows.groupBy(self.key).agg(F.min(F.struct("query_hash", "query")).alias("q")).select(
            self.key, "q.query_hash", "q.query")
        have = self.read(kind)
        if self.retry_errors:
            have = have.where(F.col("error").isNull())
        todo = one.join(have.select(self.key, "query_hash"), [self.key, "query_hash"], "left_anti")
        run = f"{self.path}/run-{uuid.uuid4().hex}"
        if isinstance(model, Call):
            spread = todo.repartition(model.parallelism, self.key) if model.parallelism else todo
            shared.make_folder(self.spark, run)
            done = spread.mapInArrow(_asker(model.call, run, self.key, most=self.file_answers), "asked bigint")
            self.asked += done.agg(F.sum("asked")).first()[0] or 0
        else:
            answers = model(todo.select(self.key, "query"))
            error = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
            answers.select(self.key, "response", error.alias("error")).join(
                todo.select(self.key, "query_hash"), self.key).select(
                self.key, "query_hash", "response", "error",
                F.unix_micros(F.current_timestamp()).alias("at")).write.parquet(run)
        return one.select(self.key, "query_hash").join(
            self.read(kind), [self.key, "query_hash"], "left").select(self.key, "response", "error")


# Ship this module's and the file helper's functions by value: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(shared)
