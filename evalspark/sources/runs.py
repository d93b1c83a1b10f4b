"""Registered runs: result tables of earlier runs, found by id.

A run's rows are a Parquet folder; the registry is a table of one row per
registration that names the folder, model, benchmark and mode. A run that is
registered again (a rerun) has a later row, which is the one that counts; the
folders of the earlier ones stay until they are removed by hand, so readers
that already resolved them are not disturbed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.sources import shared

REGISTRY = "run_id string, path string, model string, bench string, mode string, at timestamp"


class RunRegistry:
    """Runs under one folder of the shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        shared.make_folder(spark, f"{self.folder}/registry")

    @staticmethod
    def run_id(model: str, bench: str, mode: str) -> str:
        return f"{model}_{bench}_{mode}"

    def add(self, rows: DataFrame, model: str, bench: str, mode: str) -> str:
        """Writes a run's rows and registers them; returns the run's id."""
        run_id = self.run_id(model, bench, mode)
        path = f"{self.folder}/runs/{run_id}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        entry = self.spark.createDataFrame([(run_id, path, model, bench, mode)], REGISTRY.rsplit(",", 1)[0])
        entry.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.folder}/registry")
        return run_id

    def runs(self) -> DataFrame:
        """One row per run: its last registration."""
        rows = self.spark.read.schema(REGISTRY).parquet(f"{self.folder}/registry")
        last = F.max(F.struct("at", "path", "model", "bench", "mode")).alias("r")
        return rows.groupBy("run_id").agg(last).select("run_id", "r.path", "r.model", "r.bench", "r.mode", "r.at")

    def load(self, run_id: str) -> DataFrame:
        """The rows of a run."""
        found = self.runs().where(F.col("run_id") == run_id).select("path").collect()     # one row at most
        if not found:
            raise ValueError(f"no run {run_id} in {self.folder}")
        return self.spark.read.parquet(found[0].path)
