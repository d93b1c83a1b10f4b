"""Files in folders that driver and executors share, opened from Python tasks.

Functions that run in tasks use only ``pyarrow``, so that they need no installed
copy of this package on executors.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from evalspark.session import scratch_path


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(path).path
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop's path object and file system for driver-side calls."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = hadoop_path(spark, path)
    return store.exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    where, store = hadoop_path(spark, path)
    store.mkdirs(where)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, by name."""
    where, store = hadoop_path(spark, path)
    return sorted(str(f.getPath()) for f in store.listStatus(where) if f.isDirectory())


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table of their own in the shared folder: no later job makes
    them again, and a lost executor costs a read."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
