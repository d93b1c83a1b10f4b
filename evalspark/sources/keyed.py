"""Tables bucketed by a key, so that joins on it need no shuffle (J1, J3, P7 at scale).

A keyed table is a Parquet folder whose files are dealt and sorted by a hash
of the key, entered in the session's catalog with that fact. Two tables of
one key and bucket number then join, anti-join and count distinct keys bucket by
bucket: a bucket is read by one task on both sides, without an exchange. A
key with very many rows is in one bucket; tables for this are those with one row,
or few, per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a bucket on average, and buckets at most.
BUCKET_BYTES = 256 << 20
MAX_BUCKETS = 1 << 14


def bucket_count(total_bytes: int, least: int = 1) -> int:
    """Buckets for a table: a power of two, so that tables of different sizes
    still have numbers that divide each other."""
    n = 1
    while n < least or (n * BUCKET_BYTES < total_bytes and n < MAX_BUCKETS):
        n *= 2
    return n


def write_keyed(df: DataFrame, name: str, path: str, key: str | Sequence[str], buckets: int) -> DataFrame:
    """Writes ``df`` as a table bucketed and sorted by ``key`` and returns it as read."""
    keys = [key] if isinstance(key, str) else list(key)
    # one task a bucket: each bucket is one file, whose order then holds on reading
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
       .mode("errorifexists").option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def open_keyed(spark: SparkSession, name: str, path: str, key: str | Sequence[str], buckets: int) -> DataFrame:
    """Enters a folder of ``write_keyed`` in this session's catalog and reads it."""
    keys = ", ".join(f"`{k}`" for k in ([key] if isinstance(key, str) else key))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)
