"""Access to the parquet input tables of one scale factor."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy parquet readers: ``Tables(spark, dir).documents`` etc.

    Reading is lazy and each query selects only its columns, so the
    parquet scans carry a pruned ``ReadSchema`` and pushed filters.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        # Scans live as long as this object, one query: files added later are
        # seen by the next one.
        self._scans: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        df = self._scans.get(name)
        if df is None:
            df = self._scans[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def names(self) -> tuple[str, ...]:
        return TABLE_NAMES
