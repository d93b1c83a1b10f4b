"""Connected components, and tables written between jobs."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import scratch_path


#: Folders that ``new_folder`` made in this process and ``clear`` has not removed.
_MADE: list[str] = []


def give_back() -> None:
    """Returns memory that a worker has freed but still holds to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def light(run):
    """A function of batches whose worker gives its memory back at the end of each
    task: workers wait for further tasks, beside those of other stages."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


def light_group(run):
    """The same for a function of a key and its group."""
    def group(key, rows):
        out = run(key, rows)
        give_back()
        return out
    return group


#: Rows of an Arrow batch. Batches hold whole texts, on both sides of the pipe.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for the session, unless somebody has set their size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000" and not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(BATCH_ROWS))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    _MADE.append(path)
    return path


def made() -> set[str]:
    return set(_MADE)


def clear(spark: SparkSession, keep: set[str]) -> None:
    """Removes the folders made so far but those to keep, once their readers are done."""
    for path in made() - keep:
        drop_written(spark, path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of ``df`` from a Parquet table in the shared checkpoint folder.

    Cuts the lineage: a lost executor costs a read, not a new computation.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, path: str) -> None:
    """Removes a table of ``written`` that no later job reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


#: Ids (8 bytes each) sent to every task by ``without``; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not among ``ids``; null ids stay."""
    gone, _ = written(ids, "dropped-ids")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for the nodes of the
    links ``a``, ``b`` (bigint). Links with a null end or of a node to itself
    say nothing and are left out.

    Alternating large-star and small-star rounds, each written as a table,
    until a round changes nothing. Minima are pre-aggregated before their
    shuffle, so a node with very many links costs no single task more.
    """
    spark = edges.sparkSession
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        "a is not null and b is not null and a <> b").distinct()
    now, path = written(ordered, "links")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(lowest, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select(
            "e.*").where("a <> b").distinct()
        after, after_path = written(small, "links")
        drop_written(spark, path)
        before, now, path, state = state, after, after_path, _state(after)
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


class Forest:
    """Union-find over 0..n-1 whose labels stay flat, for links found in waves."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i]; links inside a tree cost one comparison."""
        label = self.label
        apart = label[a] != label[b]
        if not apart.any():
            return
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        for x, y in np.unique(np.stack([label[a[apart]], label[b[apart]]], 1), axis=0).tolist():
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        for x in sorted(root):
            root[x] = find(x)
        moved = np.fromiter(root, np.int64, len(root))
        to = np.arange(len(label))
        to[moved] = np.fromiter(root.values(), np.int64, len(root))
        self.label = to[label]
