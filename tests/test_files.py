"""File sources and sinks (R1-R7, W1-W3), responder (F2) and mode checks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evalspark.plans import modes as MO
from evalspark.plans import responder as RS
from evalspark.sources import files as FI
from evalspark.streaming.incremental import new_run_folder
from tests.conftest import local_path


@pytest.fixture()
def folder(spark):
    path = local_path(new_run_folder(spark, "test-files"))
    os.makedirs(path, exist_ok=True)
    return path


def test_tsv_with_quoted_multiline_fields(spark, folder):
    p = os.path.join(folder, "bench.tsv")
    with open(p, "w") as f:
        f.write('item\tprompt\timage\tnote\n')
        f.write('1\t"two\nlines"\tAAAA\t"has ""quotes"" and\ttab"\n')
        f.write('2\tplain\tBBBB\tNA\n')
    df = FI.load_table(spark, p)
    rows = df.orderBy("item").collect()
    assert len(rows) == 2
    assert rows[0].prompt == "two\nlines" and rows[0].note == 'has "quotes" and\ttab'
    assert rows[1].note is None                      # pandas NA word -> null
    FI.check_items(df)
    with pytest.raises(ValueError):
        FI.check_items(df.drop("image"))


def test_json_orientations(spark, folder):
    recs = os.path.join(folder, "r.json")
    with open(recs, "w") as f:
        json.dump([{"prompt": "a", "image": "x"}, {"prompt": "b", "image": "y"}], f)
    assert FI.load_table(spark, recs).count() == 2
    cols = os.path.join(folder, "c.json")
    with open(cols, "w") as f:
        json.dump({"prompt": {"0": "a", "1": "b"}, "image": {"0": "x", "1": "y"}}, f)
    got = FI.load_table(spark, cols).orderBy("row_index").collect()
    assert [(r.prompt, r.image) for r in got] == [("a", "x"), ("b", "y")]
    lines = os.path.join(folder, "l.jsonl")
    with open(lines, "w") as f:
        f.write('{"prompt": "a"}\n{"prompt": "b"}\n')
    assert FI.load_table(spark, lines).count() == 2
    with pytest.raises(ValueError):
        FI.load_table(spark, os.path.join(folder, "x.xlsx"))


def test_scan_results_and_run_metadata(spark, folder):
    for name, n in (("gpt_4_bench_ready_chain_result.tsv", 2), ("m1_bench_direct_result.tsv", 1)):
        with open(os.path.join(folder, name), "w") as f:
            model = name.split("_bench")[0]
            f.write(f"prompt\t{model}_response\tverdict\n")
            for i in range(n):
                f.write(f'"q{i}\nmore"\tr{i}\tyes\n')
    df = FI.scan_results(spark, folder, "prompt string, response string, verdict string")
    meta = FI.run_metadata(df.groupBy("file_name").count(), "file_name").orderBy("file_name").collect()
    assert [(m.model, m.bench, m.mode, m["count"]) for m in meta] == [
        ("gpt_4", "bench", "ready_chain", 2), ("m1", "bench", "direct", 1)]
    assert FI.result_file_name("m1", "/x/bench.v2.tsv", "direct") == "m1_bench_direct_result.tsv"


def test_find_response_column():
    assert FI.find_response_column(["prompt", "m_intermediate_response", "m_response"]) == "m_response"
    with pytest.raises(ValueError):
        FI.find_response_column(["a_response", "b_response"])


def test_images_and_writers(spark, folder):
    img = os.path.join(folder, "imgs")
    os.makedirs(img)
    with open(os.path.join(img, "p.png"), "wb") as f:
        f.write(bytes.fromhex("89504E470D0A1A0A") + b"\x00" * 100)
    got = FI.load_images(spark, img).first()
    assert "\n" not in got.image and got.image.startswith("iVBORw0KGgo")
    df = spark.createDataFrame([(1, ["a", "b"])], "item_id long, chain array<string>")
    FI.append_rows(df.select("item_id", FI.list_text("chain").alias("chain")), os.path.join(folder, "w1"), "tsv")
    FI.append_rows(df.select("item_id", FI.list_text("chain").alias("chain")), os.path.join(folder, "w1"), "tsv")
    back = spark.read.options(header="true", sep="\t", quote='"', escape='"').csv(os.path.join(folder, "w1"))
    assert back.count() == 2 and back.first().chain == '["a","b"]'
    FI.write_new(df, os.path.join(folder, "w2"))
    with pytest.raises(Exception):
        FI.write_new(df, os.path.join(folder, "w2"))
    FI.write_sheet(spark.createDataFrame([("r", 0.5)], "run_id string, accuracy double"), os.path.join(folder, "w3"))
    assert spark.read.option("header", "true").csv(os.path.join(folder, "w3")).count() == 1


def test_responder_keeps_errors_separate(spark):
    def call(q):
        if "boom" in q:
            raise RuntimeError("bad request")
        return q.upper()
    respond = RS.make_responder(call, parallelism=2)
    req = spark.createDataFrame([(1, "hi"), (2, "boom")], "request_id long, query string")
    got = {r.request_id: (r.response, r.error) for r in respond(req).collect()}
    assert got[1] == ("HI", None)
    assert got[2][0] is None and "bad request" in got[2][1]


def test_multi_turn_live_with_fake_responder(spark):
    respond = RS.make_responder(lambda q: f"len{len(q)}")
    items = spark.createDataFrame([(1, "Q1", ["s1", "s2", "s3"]), (2, "Q2", ["only"])],
                                  "item_id long, prompt string, chain array<string>")
    out = {r.item_id: r for r in MO.multi_turn_live(items, respond).collect()}
    assert out[1].transcript.count("\n") == 2 and out[1].transcript.startswith("step1:len")
    assert out[2].transcript == "" and out[2].response.startswith("len")


@pytest.mark.parametrize("flags,mode", [
    (MO.ModeFlags(), "chain"),
    (MO.ModeFlags(chain=True), "ready_chain"),
    (MO.ModeFlags(chain=True, multi_turn=True), "multi_turn_ready"),
    (MO.ModeFlags(extracted_info=True, chain=True), "exchange"),
    (MO.ModeFlags(multi_turn=True), "multi_turn_scratch"),
    (MO.ModeFlags(chain_only=True, has_image=False), "chain_only"),
    (MO.ModeFlags(chain_only_visual=True), "chain_only_visual"),
    (MO.ModeFlags(visual_all=True), "visual_all"),
])
def test_mode_truth_table(flags, mode):
    assert MO.resolve_mode(flags) == mode


def test_mode_errors():
    with pytest.raises(ValueError):
        MO.resolve_mode(MO.ModeFlags(multi_turn=True, chain_only=True))
    with pytest.raises(ValueError):
        MO.resolve_mode(MO.ModeFlags(has_image=False))


def test_direct_and_stepwise_modes(spark):
    items = spark.createDataFrame([(1, "q1", "AAAA"), (2, "q2", None)], "item_id long, prompt string, image string")
    resp = spark.createDataFrame([(1, "r1")], "item_id long, response string")
    done = spark.createDataFrame([(2,)], "item_id long")
    out = MO.direct(items, resp).orderBy("item_id").collect()
    assert [(r.response, r.missing) for r in out] == [("r1", 0), (None, 1)]
    assert json.loads(out[0].payload)[0]["content"][1]["image_url"]["url"].endswith("AAAA")
    assert len(json.loads(out[1].payload)[0]["content"]) == 1
    assert [r.item_id for r in MO.direct(items, resp, done).collect()] == [1]
    sw = MO.stepwise(items, resp).filter(F.col("item_id") == 1).first()
    assert sw.prompt.endswith("q1") and len(sw.prompt) > 2
