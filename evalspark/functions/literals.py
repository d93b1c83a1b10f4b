"""Python-literal text (S13, S14, F3) with a JVM fast path.

Literal text such as ``['a', 'b']`` or ``{'skills': [...]}`` is parsed
with ``from_json`` (single quotes allowed) if the whole text is within a
grammar that JSON and Python read alike. Other rows are evaluated by an
Arrow-batched pandas UDF running ``ast.literal_eval``; the texts of rows
that the JVM decides are null before they are sent.
"""

from __future__ import annotations

import ast
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark import cloudpickle
from pyspark.sql import types as T

from evalspark.functions.signs import FAST_CHARS, numeric_sign
from evalspark.functions.text import col_

SKILLS_SCHEMA = "struct<skills:array<string>>"
# Whole texts that JSON and Python read alike: plain quoted strings (no
# escapes, no quotes inside), plain numbers, lists of strings, flat dicts.
_STRING = "(?:'[^'\"\\\\\\x00-\\x1f]*+'|\"[^'\"\\\\\\x00-\\x1f]*+\")"
_STRINGS = f"\\[ *+(?:{_STRING}(?: *+, *+{_STRING})*+)?+ *+\\]"
_PAIR = f"{_STRING} *+: *+(?:{_STRING}|{_STRINGS}|-?(?:0|[1-9][0-9]{{0,14}})(?:\\.[0-9]{{1,15}})?)"
STRING_LIST_PATTERN = f"^[ \\t]*{_STRINGS} *+$"
DICT_PATTERN = f"^[ \\t]*\\{{ *+(?:{_PAIR}(?: *+, *+{_PAIR})*+)?+ *+\\}} *+$"


def _literal(text):
    if text is None:
        raise ValueError("null")
    return ast.literal_eval(text)


def python_numeric_sign(verdict, answer) -> int:
    """The rule for one pair: answer typed by int, float, literal. Integers have any
    length: the interpreter's limit on their digits is no part of the rule."""
    if verdict is None or answer is None:
        return 0
    sys.set_int_max_str_digits(0)
    try:
        target, parse = int(answer), int
    except ValueError:
        try:
            target, parse = float(answer), float
        except ValueError:
            try:
                target, parse = _literal(answer), _literal
            except Exception:
                return 0
    try:
        return int(bool(parse(verdict) == target))
    except Exception:
        return 0


def _list_of_text(text: str) -> list | None:
    try:
        v = _literal(text)
    except Exception:
        return None
    return [None if x is None else str(x) for x in v] if isinstance(v, (list, tuple)) else None


def _skills_of_text(text: str) -> list | None:
    try:
        v = _literal(text)
    except Exception:
        return None
    found = v.get("skills") if isinstance(v, dict) else None
    return [str(x) for x in found] if isinstance(found, (list, tuple)) else None


@F.pandas_udf(T.IntegerType())
def literal_equal_sign(verdict: pd.Series, answer: pd.Series) -> pd.Series:
    """the S4 rule in Python; null where the verdict or the answer is null."""
    return pd.Series([None if v is None or a is None else python_numeric_sign(v, a)
                      for v, a in zip(verdict, answer)], dtype="Int32")


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_string_list(text: pd.Series) -> pd.Series:
    """list/tuple literal -> list of str; anything else -> null."""
    return text.map(_list_of_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def literal_skills(text: pd.Series) -> pd.Series:
    """dict literal -> its 'skills' list as str; anything else -> null."""
    return text.map(_skills_of_text, na_action="ignore")


def _decided(text: Column, pattern: str) -> Column:
    return F.coalesce((F.length(text) <= FAST_CHARS) & text.rlike(pattern), F.lit(False))


def string_list_decided(text: str | Column) -> Column:
    return col_(text).isNull() | _decided(col_(text), STRING_LIST_PATTERN)


def skills_decided(metadata: str | Column) -> Column:
    """A flat dict with one mention of skills at most (of equal keys Python takes the last)."""
    m = col_(metadata)
    once = F.length(m) - F.length(F.replace(m, F.lit("skills"), F.lit(""))) <= 6
    return m.isNull() | (_decided(m, DICT_PATTERN) & once)


def string_list(text: str | Column) -> Column:
    """S13 fast path: list literal text -> array<string>; null where undecided."""
    return F.when(string_list_decided(text), F.from_json(col_(text), "array<string>"))


def skills(metadata: str | Column) -> Column:
    """S14 fast path: ``metadata.skills`` as array<string>; null where undecided.

    A ``skills`` value that is not a list gives null in either path.
    """
    return F.when(skills_decided(metadata), F.from_json(col_(metadata), SKILLS_SCHEMA).getField("skills"))


def full_string_list(text: str | Column) -> Column:
    """S13 as one expression: fast path, Python for the undecided rows."""
    t = col_(text)
    return F.coalesce(string_list(t), literal_string_list(F.when(~string_list_decided(t), t)))


def score_numeric(df: DataFrame, verdict: str, answer: str, out: str = "sign",
                  only: Column | None = None) -> DataFrame:
    """S4 for a table in one pass: JVM rules, Python only for undecided rows.

    The JVM rule decides int / float / number-list / text answers. One
    pandas UDF evaluates the Python literal rule on the rows that the JVM
    left null (tuples, quoted strings, nested lists, ...) and that ``only``
    selects; all other rows reach it as nulls.
    """
    fast = F.col("_fast")
    need = fast.isNull() if only is None else fast.isNull() & F.coalesce(only, F.lit(False))
    return (df.withColumn("_fast", numeric_sign(verdict, answer))
              .withColumn("_need", need)
              .withColumn(out, F.coalesce(fast, literal_equal_sign(
                  F.when(F.col("_need"), F.col(verdict)), F.when(F.col("_need"), F.col(answer)))))
              .drop("_fast", "_need"))


def parse_string_list(df: DataFrame, text: str, out: str) -> DataFrame:
    """S13 for a table: ``from_json``, then ``ast.literal_eval`` for the undecided rows."""
    return df.withColumn(out, full_string_list(text))


def parse_skills(df: DataFrame, metadata: str, out: str = "skills") -> DataFrame:
    """S14 for a table: fast path, Python literal rule for the undecided rows."""
    m = F.col(metadata)
    return df.withColumn(out, F.coalesce(skills(m), literal_skills(F.when(~skills_decided(m), m))))


def to_text(c: str | Column) -> Column:
    """List -> JSON text for TSV storage (parquet keeps the array)."""
    return F.to_json(col_(c))


# Ship this module's Python functions by value, so executors need no
# installed copy of the package to run the pandas UDFs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
