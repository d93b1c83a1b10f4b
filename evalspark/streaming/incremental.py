"""Restartable incremental scoring and response collection.

The reference resumes by counting rows already in its output file. Here
the resume state is a Structured Streaming checkpoint: a file source
remembers which input files were processed, so a re-run picks up only
new files and a finished run adds nothing. ``trigger(availableNow=True)``
processes what is there and stops, i.e. a restartable batch job.
Checkpoint and output folders live under the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.joins import one_per_key
from evalspark.session import scratch_path
from evalspark.sources.shared import exists, hadoop_path


def new_run_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out_path: str,
                 checkpoint: str, partition_by: tuple[str, ...] = ()) -> int:
    """Apply a row-wise scoring function to a stream and append to parquet.

    Returns the number of rows that this run appended (0 when the checkpoint
    says everything was already scored), counted in the target itself, so
    it is exact for any number of micro-batches.
    """
    spark = stream.sparkSession
    before = _rows(spark, out_path)
    scored = score(stream)
    w = (scored.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start().awaitTermination()
    return _rows(spark, out_path) - before


def _rows(spark: SparkSession, path: str) -> int:
    """Rows of a parquet folder (from its footers), 0 if there is none yet."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """A stream of the files in a folder, or of one file (streams watch folders: the one it is in)."""
    where, store = hadoop_path(spark, path)
    if store.exists(where) and not store.getFileStatus(where).isDirectory():
        path = where.getParent().toString()
        options["pathGlobFilter"] = re.sub(r"([\\*?\[\]{}])", r"\\\1", where.getName())
    r = spark.readStream.schema(schema).format(fmt)
    if fmt in ("csv", "tsv"):
        r = r.format("csv").options(header="true", multiLine="true", quote='"', escape='"',
                                    sep="\t" if fmt == "tsv" else ",")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.options(**options).load(path)


#: State of streams in RocksDB: on local disk, with changes uploaded to the checkpoint. Each
#: partition has several stores: they share an executor's memory, and none reserves disk ahead
#: (4 MB a store, whatever it holds).
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def collect_responses(responses: DataFrame, requests: DataFrame, target: str, checkpoint: str,
                      key: str = "request_id", keep: str = "30 days") -> int:
    """Attach newly arriving responses to their requests by key; appends to ``target``.

    Keyed stream state replaces a look at what was written before, so a batch costs
    what it brings, whatever the target holds. The state remembers which requests
    have been answered (the first response of a request counts) and, if the requests
    are a stream too, parks responses that come before their request and requests that
    wait for their response. State is kept for ``keep`` after its arrival; a response
    without a request by then, or without one in a static request table, is written
    with nulls in the request's columns. Replayed batches write nothing twice,
    and a new checkpoint with an old target adds to it and loses nothing.
    Rows with a null key are left out. Returns the number of rows that this run wrote.
    """
    spark = responses.sparkSession
    others = [c for c in requests.columns if c != key]
    arrived = responses.where(F.col(key).isNotNull()).withColumn("_answered", F.current_timestamp())
    once = arrived.withWatermark("_answered", keep).dropDuplicatesWithinWatermark([key])
    if requests.isStreaming:
        asked = requests.where(F.col(key).isNotNull()).withColumnRenamed(key, "_key").withColumn(
            "_asked", F.current_timestamp()).withWatermark("_asked", keep).dropDuplicatesWithinWatermark(["_key"])
        near = F.expr(f"_asked between _answered - interval {keep} and _answered + interval {keep}")
        joined = once.join(asked, (F.col(key) == F.col("_key")) & near, "left_outer")
    else:
        joined = once.join(one_per_key(requests, key), key, "left")
    rows = joined.select(*responses.columns, *others)
    # A batch has a folder of its own, by its checkpoint and number: replayed it is
    # written over, and no other checkpoint's batches are touched.
    run = f"{target}/run={hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}"
    written = 0

    def write(batch: DataFrame, epoch: int) -> None:
        nonlocal written
        folder = f"{run}/epoch={epoch}"
        batch.write.mode("overwrite").parquet(folder)
        written += batch.sparkSession.read.schema(batch.schema).parquet(folder).count()      # from the footers

    before = {name: spark.conf.get(name, None) for name in ROCKS}
    for name, value in ROCKS.items():
        spark.conf.set(name, value)
    try:
        (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start().awaitTermination())
        return written
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
