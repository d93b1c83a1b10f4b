"""Headers found by tasks, variant JSON, registered runs, keyed tables."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from evalspark.operators import joins as J
from evalspark.sources import files as FI
from evalspark.sources import keyed as KT
from evalspark.sources import runs as RN
from evalspark.streaming.incremental import new_run_folder
from tests.conftest import local_path


def write_runs(folder, n):
    os.makedirs(folder)
    for i in range(n):
        cols = ["item", f"m{i}_response", "note"]
        cols = cols[i % 3:] + cols[:i % 3]
        with open(os.path.join(folder, f"m{i}_bench_direct_result.tsv"), "w") as f:
            f.write("\t".join(cols) + "\n")
            for k in range(3):
                value = {"item": f"00{k}", f"m{i}_response": f'"r{i}\n{k} ""q"""', "note": "NA" if k else "xé"}
                f.write("\t".join(value[c] for c in cols) + "\n")
        if i == 0:
            open(os.path.join(folder, "empty.tsv"), "w").close()


def jobs_of(spark, fn):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    out = fn()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("none", "")
    return n, out


def test_runs_are_scanned_by_header_in_a_fixed_number_of_jobs(spark):
    counts = {}
    for n in (4, 120):
        folder = os.path.join(local_path(new_run_folder(spark, "runs")), "r")
        write_runs(folder, n)
        counts[n], rows = jobs_of(spark, lambda: FI.scan_runs(spark, folder, ["item", "note", "absent"]).collect())
        got = {(r.file_name, r.item): (r.response, r.note, r.absent) for r in rows}
        assert len(got) == 3 * n
        assert got[("m1_bench_direct_result.tsv", "002")] == ('r1\n2 "q"', None, None)
        assert got[("m3_bench_direct_result.tsv", "000")] == ('r3\n0 "q"', "xé", None)
    assert counts[4] == counts[120]


def test_odd_headers(spark):
    folder = local_path(new_run_folder(spark, "runs"))
    os.makedirs(folder)
    with pytest.raises(ValueError):
        FI.scan_runs(spark, folder, ["a"])
    long = "c" * 40_000
    with open(os.path.join(folder, "a.tsv"), "w") as f:
        f.write(f'{long}\t"two\nlines"\tx_response\n1\t2\t3\n')
    assert [tuple(r)[:3] for r in FI.scan_runs(spark, folder, [long, "two\nlines"]).collect()] == [("1", "2", "3")]
    with open(os.path.join(folder, "b.tsv"), "w") as f:
        f.write("x_response\ty_response\n1\t2\n")
    with pytest.raises(ValueError, match="1 files differ.*b.tsv"):
        FI.scan_runs(spark, folder, ["a"])


def test_column_json_with_a_schema(spark):
    folder = local_path(new_run_folder(spark, "json"))
    os.makedirs(folder)
    path = os.path.join(folder, "c.json")
    with open(path, "w") as f:
        json.dump({"prompt": {"0": "a", "10": "b", "2": None}, "n": {"0": 1, "10": "x", "2": 2.5},
                   "tags": {"0": ["u", "v"]}, "extra": {}}, f)
    n, df = jobs_of(spark, lambda: FI.columns_to_rows(spark, path, "prompt string, n double, tags array<string>, none int"))
    assert n == 0
    assert [tuple(r) for r in df.orderBy("row_index").collect()] == [
        (0, "a", 1.0, ["u", "v"], None), (2, None, 2.5, None, None), (10, "b", None, None, None)]
    assert FI.load_table(spark, path).columns == ["row_index", "extra", "n", "prompt", "tags"]
    records = os.path.join(folder, "r.json")
    with open(records, "w") as f:
        json.dump([{"0": {"1": 2}}], f)
    assert not FI.column_oriented(spark, records) and FI.column_oriented(spark, path)


def test_registered_runs(spark):
    registry = RN.RunRegistry(spark, new_run_folder(spark, "registry"))
    other = spark.createDataFrame([(1, "i1", "x", 1), (1, "i2", "y", 2), (3, "i3", "z", 1), (None, "n", "n", 1)],
                                  "item_id long, a_intermediate_response string, b_intermediate_response_2 string, try int")
    run = registry.add(other.limit(1), "gpt_4", "bench", "chain")
    assert registry.add(other, "gpt_4", "bench", "chain") == run == "gpt_4_bench_chain"
    assert registry.runs().count() == 1
    again = RN.RunRegistry(spark, registry.folder)
    items = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    got = {r.item_id: r.exchange_info for r in J.attach_exchange(items, again.load(run), order="try").collect()}
    assert got == {1: ["i2", "y"], 2: None, 3: ["i3", "z"]}
    with pytest.raises(ValueError):
        registry.load("nobody_bench_chain")


def test_keyed_tables_join_without_a_shuffle(spark):
    folder, name = new_run_folder(spark, "keyed"), "t" + uuid.uuid4().hex[:12]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = KT.write_keyed(spark.range(500).select(F.col("id").alias("item_id"), F.lit("p").alias("prompt")),
                               f"{name}_items", f"{folder}/items", "item_id", 8)
        done = KT.write_keyed(spark.range(0, 500, 3).select(F.col("id").alias("item_id"), F.lit("r").alias("response")),
                              f"{name}_done", f"{folder}/done", "item_id", 8)
        for df, n in ((J.align(done, items), 167), (J.pending(items, done), 333),
                      (J.completeness(items, done, "item_id"), 1)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            shuffles = [line for line in plan.splitlines() if "Exchange" in line and "SinglePartition" not in line]
            assert not shuffles, plan
            assert df.count() == n
        spark.sql(f"DROP TABLE {name}_items")
        back = KT.open_keyed(spark, f"{name}_back", f"{folder}/items", "item_id", 8)
        plan = J.align(done, back)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and J.align(done, back).count() == 167
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for part in ("items", "done", "back"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
    assert KT.bucket_count(0) == 1 and KT.bucket_count(3 * KT.BUCKET_BYTES) == 4


def test_one_per_key_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 1, "c")], "k int, o int, v string")
    for order in ("o", None):
        got = {r.k: (r.v, r.n) for r in J.one_per_key(df, "k", order, count="n").collect()}
        assert got == {None: ("b" if order else "a", 2), 1: ("c", 1)}


def test_positions_of_a_stored_table(spark):
    path = new_run_folder(spark, "items") + "/t"
    spark.range(1000).select((999 - F.col("id")).alias("item_id"), F.lit("p").alias("prompt")).repartitionByRange(
        7, "item_id").sortWithinPartitions("item_id").write.parquet(path)
    n, df = jobs_of(spark, lambda: FI.positioned(spark, path))
    assert n <= 1                        # the schema, read from a footer
    assert df.where("position <> item_id").count() == 0 and df.count() == 1000
    assert [r.item_id for r in J.slice_from(df, "position", 997).orderBy("position").collect()] == [997, 998, 999]


def test_dense_positions_without_a_job(spark):
    from evalspark.operators import windows as W
    keys = [None, "a", "b"]
    rows = [(keys[i % 3], v) for i, v in enumerate(
        [*range(0, 50), *range(2**20 - 5, 2**20 + 5), *range(2**40 - 3, 2**40 + 3), -1, -(2**50), 2**62, -(2**63)])]
    df = spark.createDataFrame(rows, "g string, o long").repartition(5)
    n, out = jobs_of(spark, lambda: W.dense_positions(df, "o", ["g"]))
    assert n == 0
    want = {(g, v): sorted(x for k, x in rows if k == g).index(v) for g, v in rows}
    assert {(r.g, r.o): r.position for r in out.collect()} == want
    whole = {r.o: r.position for r in W.dense_positions(df, "o").collect()}
    assert whole == {v: i for i, v in enumerate(sorted(x for _, x in rows))}
    text = df.select("g", F.col("o").cast("string").alias("o"))
    got = {(r.g, r.o): r.position for r in W.dense_positions(text, "o", ["g"], num_partitions=4).collect()}
    assert got == {(g, str(v)): sorted(str(x) for k, x in rows if k == g).index(str(v)) for g, v in rows}
