"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "evalspark",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster ``master`` stays ``None`` and the cluster's own settings
    win; ``shuffle_partitions`` is only a starting point because AQE
    coalesces small partitions and splits skewed ones at run time.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.master.startswith("local"):
        size_shuffles(spark)
    ensure_checkpoint_dir(spark)
    return spark


def size_shuffles(spark: SparkSession, advisory: str = "256m") -> dict[str, str]:
    """Shuffle sizing for a cluster, applied only to settings nobody has made.

    Shuffles start twice as wide as the cluster's task slots (at least
    ``spark.sql.shuffle.partitions``), so a shuffle of a large input is
    never squeezed into the 200-partition default. AQE then merges small
    partitions up to ``advisory`` bytes and splits skewed ones, so a
    shuffle of any size ends in partitions of about that size. Returns
    the settings it made.
    """
    conf = spark.conf
    launch = spark.sparkContext.getConf()
    slots = spark.sparkContext.defaultParallelism
    base = int(conf.get("spark.sql.shuffle.partitions"))
    wanted = {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(base, 2 * slots)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory,
    }
    made = {}
    for key, value in wanted.items():
        if conf.get(key, None) is None and not launch.contains(key):
            conf.set(key, value)
            made[key] = value
    return made


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, honouring ``spark.checkpoint.dir``.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that is
    always used. Only a local-mode session (tests, bench) without the
    setting gets a fresh folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="evalspark-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)
