"""Restartable incremental scoring (I1) and response collection."""

import contextlib
import glob
import os
import time

import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as E
from evalspark.plans import suites as SU
from evalspark.streaming import incremental as INC
from tests.conftest import SF_SMALL, local_path


def _write_parts(spark, folder, pdfs):
    for i, pdf in enumerate(pdfs):
        spark.createDataFrame(pdf).coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, f"part{i}"))


SCHEMA = "item_no long, run_id string, gt_answer int, verdict string"


def test_restart_adds_nothing_and_picks_up_new_files(spark):
    run = local_path(INC.new_run_folder(spark, "test-i1"))
    src = os.path.join(run, "src")
    os.makedirs(src, exist_ok=True)
    first = pd.DataFrame({"item_no": [1, 2, 3], "run_id": ["r"] * 3, "gt_answer": [1, 0, 1],
                          "verdict": ["Yes.", "no", "No"]})
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(os.path.join(src, "a"))

    def score(s):
        return SU.HALLUCINATION.score_rows(s).select("item_no", "run_id", "sign")

    def run_once():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src)
        return INC.score_stream(stream, score, os.path.join(run, "out"), os.path.join(run, "ckpt"))

    assert run_once() == 3
    assert run_once() == 0                      # nothing new: nothing scored again
    second = pd.DataFrame({"item_no": [4], "run_id": ["r"], "gt_answer": [0], "verdict": ["yes"]})
    spark.createDataFrame(second, SCHEMA).coalesce(1).write.parquet(os.path.join(src, "b"))
    assert run_once() == 1
    out = spark.read.parquet(os.path.join(run, "out"))
    assert sorted((r.item_no, r.sign) for r in out.collect()) == [(1, 1), (2, 1), (3, 0), (4, 0)]


def test_response_collection_is_idempotent(spark):
    run = local_path(INC.new_run_folder(spark, "test-i2"))
    src = os.path.join(run, "src")
    requests = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "request_id long, prompt string")
    schema = "request_id long, response string"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], schema).write.parquet(os.path.join(src, "x"))

    def run_once():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        return INC.collect_responses(stream, requests, os.path.join(run, "t"), os.path.join(run, "c"))

    run_once()
    spark.createDataFrame([(2, "b"), (3, "c")], schema).write.parquet(os.path.join(src, "y"))
    run_once()
    got = spark.read.parquet(os.path.join(run, "t")).orderBy("request_id").collect()
    assert [(r.request_id, r.response) for r in got] == [(1, "a"), (2, "b"), (3, "c")]
    assert spark.read.parquet(os.path.join(run, "t")).filter(F.col("request_id") == 2).count() == 1


def test_early_responses_wait_for_their_requests(spark):
    run = local_path(INC.new_run_folder(spark, "test-i2"))
    answers, asked, target = (os.path.join(run, n) for n in ("answers", "asked", "t"))
    a, q = "request_id long, response string", "request_id long, prompt string"

    def add(folder, name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(folder, name))

    def run_once():
        read = spark.readStream.option("recursiveFileLookup", "true")
        return INC.collect_responses(read.schema(a).parquet(answers), read.schema(q).parquet(asked), target,
                                     os.path.join(run, "c"))

    def rows():
        return sorted(tuple(r) for r in spark.read.parquet(target).select("request_id", "prompt", "response").collect())

    add(answers, "1", [(1, "a"), (2, "b"), (None, "n")], a)
    add(asked, "1", [(1, "q1"), (5, "q5")], q)
    assert run_once() == 1 and rows() == [(1, "q1", "a")]
    assert run_once() == 0
    add(asked, "2", [(2, "q2"), (1, "again")], q)        # the request of an early answer
    add(answers, "2", [(1, "late"), (5, "e")], a)        # a second answer, and one to a waiting request
    assert run_once() == 2 and rows() == [(1, "q1", "a"), (2, "q2", "b"), (5, "q5", "e")]


def test_an_old_target_keeps_its_rows_under_a_new_checkpoint(spark):
    run = local_path(INC.new_run_folder(spark, "test-i2"))
    src, target = os.path.join(run, "src"), os.path.join(run, "t")
    requests = spark.createDataFrame([(1, "q1"), (2, "q2")], "request_id long, prompt string")
    for i, (folder, checkpoint) in enumerate((("x", "c1"), ("y", "c2"))):
        spark.createDataFrame([(i + 1, "a"), (9 + i, "none")], "request_id long, response string").write.parquet(
            os.path.join(src, folder))
        stream = spark.readStream.schema("request_id long, response string").parquet(os.path.join(src, folder))
        assert INC.collect_responses(stream, requests, target, os.path.join(run, checkpoint)) == 2
    got = sorted(tuple(r) for r in spark.read.parquet(target).select("request_id", "prompt").collect())
    assert got == [(1, "q1"), (2, "q2"), (9, None), (10, None)]


def _as_folders(spark, folder, tables):
    """The small tables, each dealt over a folder of files."""
    for name in E.catalog._t(spark, SF_SMALL).names:
        rows = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        if name in tables:
            rows.repartition(3).write.parquet(f"{folder}/{name}.parquet")
        else:
            os.symlink(f"{SF_SMALL}/{name}.parquet", f"{folder}/{name}.parquet")


def test_scoring_reads_tables_that_are_folders(spark, tmp_path):
    _as_folders(spark, tmp_path, {"documents", "labels"})
    query = E.queries()["incremental_scoring"]
    one, many = (sorted(map(tuple, query(spark, str(d)).collect())) for d in (SF_SMALL, tmp_path))
    assert many == one and one


def test_a_stream_of_one_file_leaves_its_neighbours_alone(spark, tmp_path):
    for name in ("a[1].parquet", "a1.parquet"):
        pd.DataFrame({"x": [name]}).to_parquet(tmp_path / name)
    stream = INC.read_stream(spark, str(tmp_path / "a1.parquet"), "x string")
    assert INC.score_stream(stream, lambda s: s, str(tmp_path / "out"), str(tmp_path / "c")) == 1
    assert [r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a1.parquet"]


def test_responses_are_read_from_tables_that_are_folders(spark, tmp_path):
    _as_folders(spark, tmp_path, {"conversations"})
    query = E.queries()["response_collection"]
    one, many = (sorted(map(tuple, query(spark, str(d)).collect())) for d in (SF_SMALL, tmp_path))
    assert many == one and one


def test_small_state_reserves_no_disk(spark):
    run = local_path(INC.new_run_folder(spark, "test-i2"))
    src, began = os.path.join(run, "src"), time.time()
    spark.createDataFrame([(i, "a") for i in range(100)], "request_id long, response string").write.parquet(src)
    requests = spark.createDataFrame([(1, "q")], "request_id long, prompt string")
    stream = INC.read_stream(spark, src, "request_id long, response string")
    assert INC.collect_responses(stream, requests, os.path.join(run, "t"), os.path.join(run, "c")) == 100
    local = spark.sparkContext.getConf().get("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS", "/tmp")).split(",")[0]
    ahead = []                  # disk that files of the stores hold beyond their length
    for folder in glob.glob(f"{local}/spark-*/StateStoreId*/workingDir-*"):
        for name in os.listdir(folder):
            with contextlib.suppress(OSError):
                at = os.stat(os.path.join(folder, name))
                if at.st_mtime >= began - 1:
                    ahead.append(at.st_blocks * 512 - at.st_size)
    assert ahead and max(ahead) < 1 << 20
