"""Key-based alignment, resume and projections.

The reference aligns tables by row position; here every alignment is an
equi-join on an explicit key, so order never matters and Spark chooses
the join strategy from table sizes (broadcast only under the configured
size threshold, otherwise a shuffle join that AQE can split when skewed).
Keys taken from the "other" side are de-duplicated first, so a repeated
key never multiplies rows or piles up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.chains import reusable


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def one_per_key(df: DataFrame, key: str | Sequence[str], order: str | None = None,
                count: str | None = None) -> DataFrame:
    """One row per key, the same on every run: the latest by ``order``, among
    equals (or without an order) the row whose other values are smallest.
    ``count`` names a column for the number of rows that the key had."""
    k = _keys(key)
    rest = [c for c in df.columns if c not in k]
    row = F.struct(*rest) if rest else F.struct(F.lit(None).alias("_"))
    if order:
        latest = df.groupBy(*k).agg(F.max(order).alias("_latest"), F.count(F.lit(1)).alias("_n"))
        # null keys are a key like any other, with or without an order
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(k)]
        latest = latest.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(k)), "_latest", "_n")
        df = df.join(latest, [*same, F.col(order).eqNullSafe(F.col("_latest"))], "inner")
        out = df.groupBy(*k).agg(F.min(row).alias("_r"), F.max("_n").alias("_n"))
    else:
        out = df.groupBy(*k).agg(F.min(row).alias("_r"), F.count(F.lit(1)).alias("_n"))
    return out.select(*k, *(F.col("_r")[c].alias(c) for c in rest),
                      *([F.col("_n").alias(count)] if count else []))


def align(responses: DataFrame, items: DataFrame, key: str | Sequence[str] = "item_id") -> DataFrame:
    """Responses next to their items (inner equi-join, never positional)."""
    return responses.join(items, _keys(key), "inner")


def exchange_columns(df: DataFrame, pattern: str = "intermediate_response") -> list[str]:
    """Columns whose name contains ``pattern`` (plan-time discovery)."""
    return [c for c in df.columns if pattern in c]


def attach_exchange(items: DataFrame, other: DataFrame, key: str | Sequence[str] = "item_id",
                    pattern: str = "intermediate_response", out: str = "exchange_info",
                    order: str | None = None) -> DataFrame:
    """Another run's intermediate responses as an array column (left join)."""
    cols = exchange_columns(other, pattern)
    if not cols:
        raise ValueError(f"no column containing {pattern!r}")
    k = _keys(key)
    right = other.select(*k, F.array(*[F.col(c).cast("string") for c in cols]).alias(out),
                         *([order] if order else []))
    return items.join(one_per_key(right, k, order).select(*k, out), k, "left")


def pending(items: DataFrame, done: DataFrame, key: str | Sequence[str] = "item_id") -> DataFrame:
    """Items without a stored result (anti-join on the key, not a row count)."""
    k = _keys(key)
    return items.join(done.select(*k).distinct(), k, "left_anti")


def fill_missing(items: DataFrame, generated: DataFrame, key: str | Sequence[str],
                 old: str, new: str, out: str = "chain", order: str | None = None) -> DataFrame:
    """Keep a reusable existing value, otherwise take the generated one."""
    k = _keys(key)
    right = generated.select(*k, F.col(new).alias("_new"), *([order] if order else []))
    right = one_per_key(right, k, order).select(*k, "_new")
    joined = items.join(right, k, "left")
    keep = reusable(F.col(old))
    return (joined.withColumn(out, F.when(keep, F.col(old)).otherwise(F.col("_new")))
                  .withColumn("chain_source", F.when(keep, F.lit("existing"))
                              .when(F.col("_new").isNotNull(), F.lit("generated"))
                              .otherwise(F.lit("none")))
                  .drop("_new"))


def attach_responses(requests: DataFrame, responses: DataFrame, key: str | Sequence[str] = "request_id",
                     response: str = "response", out: str = "response", order: str | None = None) -> DataFrame:
    """The model call as a join with a response table; ``missing`` flags gaps.

    A response table with an ``error`` column keeps it. Of several
    responses to a request the one of ``one_per_key`` is taken.
    """
    k = _keys(key)
    kept = ["error"] if "error" in responses.columns and "error" not in requests.columns else []
    right = responses.select(*k, F.col(response).alias(out), *kept, *([order] if order else []))
    right = one_per_key(right, k, order).select(*k, out, *kept)
    return (requests.join(right, k, "left")
                    .withColumn("missing", F.col(out).isNull().cast("int")))


def append(prior: DataFrame, new: DataFrame) -> DataFrame:
    """New rows after prior ones; columns matched by name, absent ones null."""
    return prior.unionByName(new, allowMissingColumns=True)


def drop_heavy(df: DataFrame, cols: Sequence[str] = ("image",)) -> DataFrame:
    """Drop the image payload so it is neither scanned nor shuffled."""
    return df.drop(*cols)


def slice_from(df: DataFrame, position: str, start: int) -> DataFrame:
    """Rows at or after ``start`` on an explicit order key."""
    return df.filter(F.col(position) >= start)


def slice_after_done(df: DataFrame, position: str, done: DataFrame) -> DataFrame:
    """P2 as a resume cut: skip as many leading rows as ``done`` holds.

    The count is a scalar subquery: computed once by the cluster and used
    as a literal in the filter (no join, nothing collected by our code).
    """
    start = done.agg(F.count(F.lit(1))).scalar()
    return df.filter(F.col(position) >= start)


def lookup(df: DataFrame, key: str, value, cols: Sequence[str] = ("prompt", "image")) -> DataFrame:
    """Point lookup by key (pushed down to the parquet scan as a filter)."""
    return df.filter(F.col(key) == F.lit(value)).select(key, *cols)


def batch_ids(df: DataFrame, position: str, size: int, out: str = "batch_id") -> DataFrame:
    """Fixed-size batches from a dense 0-based position."""
    if size < 1:
        raise ValueError("batch size must be positive")
    p = F.col(position).cast("long")
    return df.withColumn(out, F.expr(f"`{position}` div {int(size)}L") if size > 1 else p)


def missing_chain(df: DataFrame, chain: str) -> Column:
    """Null or empty chain."""
    c = F.col(chain)
    return c.isNull() | (F.size(c) == 0)


def completeness(expected: DataFrame, actual: DataFrame, key: str | Sequence[str],
                 by: Sequence[str] = ()) -> DataFrame:
    """Distinct expected keys vs distinct keys present in the results."""
    k = _keys(key)
    keys = expected.select(*by, *k).distinct()
    e = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"))
    got = actual.select(*by, *k).distinct().join(keys, [*by, *k], "left_semi")
    if by:
        a = got.groupBy(*by).agg(F.count(F.lit(1)).alias("actual"))
        out = e.join(a, list(by), "left")
    else:
        # two global counts: the second one as a scalar subquery
        out = e.withColumn("actual", got.agg(F.count(F.lit(1))).scalar())
    return out.withColumns({
        "actual": F.coalesce(F.col("actual"), F.lit(0)),
        "complete": (F.col("expected") == F.coalesce(F.col("actual"), F.lit(0))).cast("int")})
