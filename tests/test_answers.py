"""Stored answers: every request asked once over actions, restarts and failed tasks."""

import os

import pytest
from pyspark.sql import functions as F

from evalspark.plans import modes as MO
from evalspark.plans import responder as RS
from evalspark.plans import suites as SU
from evalspark.plans.answers import AnswerTable, Call
from evalspark.streaming.incremental import new_run_folder
from tests.conftest import local_path

ITEMS = "item_no long, gt_answer int, response string"


def counted(spark, fn=lambda q: "Yes."):
    calls = spark.sparkContext.accumulator(0)

    def call(query):
        calls.add(1)
        return fn(query)
    return calls, Call(call, parallelism=3)


def rows(spark, n, start=0):
    return spark.createDataFrame([(i, i % 2, f"text {i}") for i in range(start, n)], ITEMS)


def test_one_call_a_request_over_actions_and_a_restart(spark):
    folder = new_run_folder(spark, "answers")
    calls, model = counted(spark)
    judged = SU.judge(rows(spark, 20), SU.HALLUCINATION, model, answers=AnswerTable(spark, folder))
    assert judged.count() == 20
    assert judged.agg(F.sum("sign")).first()[0] == 10
    assert len(judged.orderBy("item_no").collect()) == 20
    assert calls.value == 20
    again = SU.judge(rows(spark, 30), SU.HALLUCINATION, model, answers=AnswerTable(spark, folder))
    assert again.where("verdict = 'Yes.'").count() == 30
    assert calls.value == 30


def test_a_responder_is_stored_too(spark):
    calls, model = counted(spark)
    judged = SU.judge(rows(spark, 6), SU.HALLUCINATION, RS.make_responder(model.call), order=None)
    assert judged.count() == 6 and judged.where("sign = 1").count() == 3
    assert calls.value == 6


def test_a_changed_text_is_asked_anew_and_errors_on_demand(spark):
    folder = new_run_folder(spark, "answers")

    def fails(query):
        raise RuntimeError("down")
    req = spark.createDataFrame([("a", "q1"), ("b", "q2"), ("b", "q2"), ("c", None), (None, "q3")], "request_id string, query string")
    got = {r.request_id: (r.response, r.error) for r in AnswerTable(spark, folder).ask(req, Call(fails)).collect()}
    assert got == {k: (None, "RuntimeError: down") for k in ("a", "b")}
    calls, model = counted(spark, str.upper)
    AnswerTable(spark, folder).ask(req, model)
    assert calls.value == 0
    got = {r.request_id: r.response for r in AnswerTable(spark, folder, retry_errors=True).ask(req, model).collect()}
    assert got["a"] == "Q1" and got["b"] == "Q2"
    changed = spark.createDataFrame([("a", "other")], "request_id string, query string")
    assert [r.response for r in AnswerTable(spark, folder).ask(changed, model).collect()] == ["OTHER"]
    assert {r.request_id: r.response for r in AnswerTable(spark, folder).latest("string").collect()}["a"] == "OTHER"


def test_a_stopped_job_leaves_its_answers(spark):
    """A call that ends its worker stops the job; the next run asks for the rest only."""
    folder = new_run_folder(spark, "answers")
    mark = os.path.join(local_path(new_run_folder(spark, "mark")), "gone")
    os.makedirs(os.path.dirname(mark))
    calls = spark.sparkContext.accumulator(0)
    req = spark.range(40).select(F.col("id").alias("request_id"), F.concat(F.lit("q"), "id").alias("query")).coalesce(1)

    def call(query):
        with open(mark + query, "a") as f:
            f.write("x")
        if query == "q25" and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return query
    with pytest.raises(Exception):
        AnswerTable(spark, folder, file_answers=5).ask(req, Call(call, parallelism=1))
    table = AnswerTable(spark, folder, file_answers=5)
    got = {r.request_id: r.response for r in table.ask(req, Call(call, parallelism=1)).collect()}
    assert got == {i: f"q{i}" for i in range(40)}
    asked = {i: os.path.getsize(mark + f"q{i}") for i in range(40)}
    assert sum(n > 1 for n in asked.values()) <= 5       # the unfinished file's at most
    assert table.asked < 40 and calls.value == 0


ITEM_ROWS = [(1, "Q1", ["s1", "s2", "s3"]), (2, "Q2", ["only"]), (3, "Q3", ["a", "b"]), (4, "Q4", [])]


def test_multi_turn_stops_and_resumes(spark):
    items = spark.createDataFrame(ITEM_ROWS, "item_id long, prompt string, chain array<string>")
    folder = new_run_folder(spark, "answers")
    calls, model = counted(spark, lambda q: f"len{len(q)}")
    part = {r.item_id: r for r in MO.multi_turn(items, model, AnswerTable(spark, folder), stop_after=1).collect()}
    assert calls.value == 2 and part[1].transcript.startswith("step1:len") and part[1].response is None
    whole = {r.item_id: r for r in MO.multi_turn(items, model, AnswerTable(spark, folder)).collect()}
    assert calls.value == 2 + 1 + 3
    assert whole[1].transcript.count("\n") == 2 and whole[3].transcript == part[3].transcript
    assert all(whole[i].response.startswith("len") for i in (1, 2, 3)) and 4 not in whole
    fresh = {r.item_id: r for r in MO.multi_turn(items, model).collect()}
    assert {i: r.response for i, r in fresh.items()} == {i: r.response for i, r in whole.items()}


def test_multi_turn_from_scratch(spark):
    items = spark.createDataFrame([(1, "good"), (2, "late"), (3, "never")], "item_id long, prompt string")
    tries = spark.sparkContext.accumulator(0)

    def chain(query):
        tries.add(1)
        return " \n" if "never" in query else "one\ntwo"
    _, model = counted(spark, lambda q: "seen")
    folder = new_run_folder(spark, "answers")
    out = {r.item_id: r for r in MO.multi_turn_scratch(items, Call(chain), model, AnswerTable(spark, folder)).collect()}
    assert tries.value == 1 + 1 + 3
    assert out[1].transcript == "step1:seen\n" and out[2].response == "seen"
    assert out[3].status == "exhausted" and out[3].response is None


def test_request_parts(spark):
    df = spark.createDataFrame([("12/c3",), ("a/b/s10",), ("x\ny/f",)], "request_id string")
    assert [tuple(r) for r in df.select(*MO.request_parts()).collect()] == [
        ("12", "c", 3), ("a/b", "s", 10), ("x\ny", "f", None)]


@pytest.mark.parametrize("kind,verdict,answer,sign", [
    ("free_answer", "correct", "x", 1), ("free_answer", "x", "x", 0), ("number", " +12", "12", 1), ("number", "12.0", "12", 0),
    ("choice", "so (a) it is", "(a)", 1), ("yes_no", "so (a) it is", "(a)", 1), ("other", "x", "x", 0), (None, "x", "x", 0)])
def test_sign_goes_by_kind(spark, kind, verdict, answer, sign):
    suite = SU.Suite("s", answer=lambda df: F.col("answer"), sign=SU._column_sign(SU.S.contains_sign), metrics=SU.summary("kind"),
                     kind="choice", rule=SU.S.contains_sign)
    df = spark.createDataFrame([(1, kind, verdict, answer, "r")], "item_no int, kind string, v string, answer string, response string")
    got = SU.judge(df, suite, "v").first()
    assert got.sign == sign
    assert (got.error == "unknown kind") == (kind in ("other", None))


def test_a_stopped_enrichment_keeps_its_finished_chains(spark):
    folder = new_run_folder(spark, "answers")
    mark = os.path.join(local_path(new_run_folder(spark, "mark")), "gone")
    os.makedirs(os.path.dirname(mark))
    items = spark.createDataFrame([(i, f"Q{i}", ["kept"] if i % 4 == 0 else [None] if i % 4 == 1 else None) for i in range(30)],
                                  "item_id long, prompt string, old_chain array<string>").coalesce(1)

    def model(query):
        name = query.rsplit("Q", 1)[1]
        with open(mark + name, "a") as f:
            f.write("x")
        if name == "21" and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return f"look {name}\nanswer"
    with pytest.raises(Exception):
        MO.enrich(items, Call(model, 1), AnswerTable(spark, folder, file_answers=4))
    table = AnswerTable(spark, folder, file_answers=4)
    early = {r.item_id: r.chain for r in MO.finished_chains(items, table).collect()}
    assert len(early) >= 8 and all(c == [f"look {i}", "answer"] and i % 4 for i, c in early.items())
    out = {r.item_id: (r.chain, r.chain_source) for r in MO.enrich(items, Call(model, 1), table).collect()}
    assert out == {i: (["kept"], "existing") if i % 4 == 0 else ([f"look {i}", "answer"], "generated") for i in range(30)}
    asked = [os.path.getsize(mark + str(i)) for i in range(30) if i % 4]
    assert sum(n > 1 for n in asked) <= 4 and not os.path.exists(mark + "4")


def test_visual_chains_fall_back_to_structured_output(spark):
    items = spark.createDataFrame([(1, "good", "AAAA"), (2, "blank", None), (3, "never", "BBBB")],
                                  "item_id long, prompt string, image string")
    seen = spark.sparkContext.accumulator(0)

    def model(query):
        seen.add(query.count("data:image"))
        return "one\ntwo" if "good" in query else " \n"
    structured = Call(lambda q: '{"inference_instruction": ["s"]}')
    got = {r.item_id: (r.chain, r.chain_form) for r in MO.generate_visual_chains(
        items, Call(model), AnswerTable(spark), structured).collect()}
    assert got == {1: (["one", "two"], "rules"), 2: (["s"], "structured"), 3: (["s"], "structured")}
    assert seen.value == 2


def test_recorded_answers_in_one_join_or_in_stages(spark):
    items = spark.createDataFrame([(1, "q1"), (2, "q2"), (3, "q3")], "item_id long, prompt string")
    chains = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (4, ["d"])], "item_id long, chain array<string>")
    first = spark.createDataFrame([(1, "i1")], "item_id long, response string")
    last = spark.createDataFrame([(1, "r1"), (2, "r2")], "item_id long, response string")
    cols = ["item_id", "final_prompt", "intermediate_response", "response", "missing"]
    staged = MO.answer_with_chain(items, chains, first, last).select(*cols)
    recorded = items.join(first.withColumnRenamed("response", "intermediate_response"), "item_id", "left").join(last, "item_id", "left")
    assert sorted(map(str, staged.collect())) == sorted(map(str, MO.answer_recorded(recorded, chains).select(*cols).collect()))
