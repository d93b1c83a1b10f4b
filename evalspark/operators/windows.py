"""Sequential state as windows and bounded aggregates.

Windows here are partitioned by an item key whose groups are bounded by
chain length or attempt count. Dense numbering inside large groups (N3)
never puts a whole group into one task: a group is numbered in segments of
its order key, and per-segment offsets come from a table of one row per segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def running_transcript(df: DataFrame, item: str, step: str, response: str,
                       out: str = "transcript") -> DataFrame:
    """Before step k, ``step1:r1\\n...step(k-1):r(k-1)\\n`` ('' at the first step).

    Step numbers in the text are positions inside the item (1-based).
    """
    w = Window.partitionBy(item).orderBy(step)
    pos = F.row_number().over(w)
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    line = F.concat(F.lit("step"), F.col("_pos").cast("string"), F.lit(":"),
                    F.coalesce(F.col(response), F.lit("")), F.lit("\n"))
    return (df.withColumn("_pos", pos)
              .withColumn(out, F.array_join(F.collect_list(line).over(prior), ""))
              .withColumn("position", F.col("_pos"))
              .drop("_pos"))


def first_valid_attempt(df: DataFrame, item: str, attempt: str, value: str,
                        max_attempts: int = 3, out: str = "chain") -> DataFrame:
    """Per item, the value of the lowest attempt (<= max) whose value is not null.

    One partial/final aggregate (``min_by``); items without one get
    ``status='exhausted'`` and a null value.
    """
    ok = F.col(value).isNotNull() & (F.col(attempt) <= max_attempts)
    order = F.when(ok, F.col(attempt))
    return (df.groupBy(item)
              .agg(F.min_by(F.when(ok, F.col(value)), order).alias(out),
                   F.min(order).alias("chosen_attempt"),
                   F.count(F.lit(1)).alias("attempts"))
              .withColumn("status", F.when(F.col("chosen_attempt").isNull(), F.lit("exhausted"))
                          .otherwise(F.lit("ok"))))


def number_steps(df: DataFrame, chain: str, keep: Sequence[str],
                 step_col: str = "step_no", value_col: str = "step") -> DataFrame:
    """One row per step with its 1-based number (``posexplode``)."""
    return (df.select(*keep, F.posexplode(chain).alias("_p", value_col))
              .withColumn(step_col, (F.col("_p") + 1).cast("int"))
              .drop("_p"))


#: Bits of an integer order key below a segment and below a segment of segments.
SEGMENT_BITS, SUPER_BITS = 20, 40


def dense_positions(df: DataFrame, order: str, by: Sequence[str] = (),
                    out: str = "position", num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its group, ordered by ``order``.

    ``order`` must be unique inside a group. With an integer key this is one plan,
    without a job of its own: rows fall into segments by the key's upper bits, so a
    segment has 2**20 rows at most whatever the group's size, and likewise a segment
    of segments; rows are numbered inside their segment and offsets are added up
    over the segments' counts. Any other key is numbered in sampled ranges
    (``ranged_positions``).
    """
    if not isinstance(df.schema[order].dataType, T.IntegralType):
        return ranged_positions(df, order, by, out, num_partitions)
    keys, value = list(by), F.col(order).cast("long")
    rows = df.withColumns({"_seg": F.shiftright(value, SEGMENT_BITS), "_sup": F.shiftright(value, SUPER_BITS)})
    local = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(order)) - 1
    counts = rows.groupBy(*keys, "_seg", "_sup").agg(F.count(F.lit(1)).alias("_n"))

    def before(count: str, *group: str, upto: str) -> Column:
        w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(upto).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(count).over(w), F.lit(0))

    inner = counts.withColumn("_inner", before("_n", *keys, "_sup", upto="_seg"))
    outer = counts.groupBy(*keys, "_sup").agg(F.sum("_n").alias("_m")).withColumn("_outer", before("_m", *keys, upto="_sup"))
    offsets = _join_by(inner, outer, [*keys, "_sup"], ["_outer"]).withColumn("_offset", F.col("_inner") + F.col("_outer"))
    numbered = rows.withColumn("_local", local)
    return _join_by(numbered, offsets, [*keys, "_seg"], ["_offset"]).withColumn(
        out, F.col("_offset") + F.col("_local")).select(*df.columns, out)


def _join_by(left: DataFrame, right: DataFrame, keys: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Columns of ``right`` at the rows of ``left`` with the same keys, null keys included."""
    named = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *take)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(named, same, "inner").drop(*(f"_k{i}" for i in range(len(keys))))


def ranged_positions(df: DataFrame, order: str, by: Sequence[str] = (), out: str = "position",
                     num_partitions: int | None = None, materialize: bool = True) -> DataFrame:
    """N3 for order keys of any type, in ranges of (group, order).

    Steps: range-partition on
    (by, order) and sort inside partitions; number rows locally from
    ``monotonically_increasing_id``; count rows per (partition, group)
    segment; prefix-sum segment counts per group (a table of at most
    partitions + groups rows); join back. The tagged rows are
    checkpointed to the reliable checkpoint folder so the ids are fixed
    even if tasks are re-run.
    """
    keys = list(by)
    # Without an explicit count the range shuffle is sized by AQE (initial
    # partition number, then adjacent ranges merged up to the advisory
    # size), so partition order still follows (by, order).
    ranged = (df.repartitionByRange(num_partitions, *keys, order) if num_partitions
              else df.repartitionByRange(*keys, order)).sortWithinPartitions(*keys, order)
    tagged = (ranged.withColumn("_pid", F.spark_partition_id())
                    .withColumn("_local", F.monotonically_increasing_id()
                                - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    if materialize:
        tagged = tagged.checkpoint(eager=True)
    seg = (tagged.groupBy("_pid", *keys)
                 .agg(F.min("_local").alias("_start"), F.count(F.lit(1)).alias("_cnt")))
    w = Window.partitionBy(*keys).orderBy("_pid") if keys else Window.orderBy("_pid")
    seg = seg.withColumn("_offset", F.coalesce(
        F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seg = seg.select(F.col("_pid").alias("_seg"), *(F.col(k).alias(f"_by{i}") for i, k in enumerate(keys)),
                     "_start", "_offset")
    same = F.col("_pid") == F.col("_seg")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_by{i}"))       # rows of a null group stay
    return (tagged.join(seg, same)
                  .withColumn(out, F.col("_offset") + F.col("_local") - F.col("_start"))
                  .select(*df.columns, out))


def first_by(df: DataFrame, item: str, order: str, value: str, out: str) -> DataFrame:
    """Per item, the value at the smallest order key (``min_by``)."""
    return df.groupBy(item).agg(F.min_by(value, order).alias(out))


def nth(col: str | Column, n: int = 1) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.try_element_at(c, F.lit(n))
