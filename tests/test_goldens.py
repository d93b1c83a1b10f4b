"""Golden vectors (FIXTURES.md section 3) for the scalar and aggregate rules."""

import pytest
from pyspark.sql import functions as F

from evalspark.functions import answers as A
from evalspark.functions import chains as CH
from evalspark.functions import literals as L
from evalspark.functions import prompts as PR
from evalspark.functions import signs as S
from evalspark.operators import metrics as M
from evalspark.operators import windows as W


def _col(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


TOKEN_CASES = [
    ("Yes.", "yes", 1), ("**No**, clearly", "no", 1), ("yes?", "yes", 0), ("no-yes", "yes", 0),
    ("The answer is (B).", "b", 1), ("a cat", "A", 1), ("(a)", "(a)", 0), ("two words", "two words", 0),
    ("", "yes", 0), ("", "", 1), ("yes sir", "yes", 1),
]


def test_token_sign(spark):
    got = _col(spark, [(v, a) for v, a, _ in TOKEN_CASES], "v string, a string", S.token_sign("v", "a"))
    assert got == [e for _, _, e in TOKEN_CASES]


def test_contains_sign(spark):
    got = _col(spark, [("I pick (A).", "(a)"), ("(a)", "(A)")], "v string, a string",
               S.contains_sign("v", "a"))
    assert got == [1, 0]


NUMERIC_CASES = [
    ("14", "14", 1), (" 14 ", "14", 1), ("+14", "14", 1), ("1_000", "1000", 1), ("14.0", "14", 0),
    ("14", "14.0", 1), ("0.60", "0.6", 1), ("6e-1", "0.6", 1), ("inf", "inf", 1),
    ("0.6d", "0.6", 0), ("nan", "nan", 0), ("unclear", "14", 0),
    ("[2007, 2008]", "[2007,2008]", 1), ("[1, 2.0]", "[1.0, 2]", 1),
    ("[2008, 2007]", "[2007, 2008]", 0), ("2007, 2008", "[2007, 2008]", 0),
    ("about ten", "about ten", 0),
    # decided by the Python literal fallback
    ("[1, 2,]", "[1, 2]", 1), ("(1, 2)", "(1, 2)", 1), ("['a', 'b']", "['a', 'b']", 1),
    ("True", "True", 1),
    ("[1], [2]", "[1]", 0), ("[1] and also [2]", "[1]", 0), ("[1]]", "[1]", 0), ("[1] [2]", "[1] [2]", 0),
    ("[Infinity]", "[Infinity]", 0), ("[9007199254740992]", "[9007199254740993]", 0),
    ("[9007199254740993]", "[9007199254740993]", 1), ("(1, 2)", "(1,2)", 1), ("(1, 2)", "[1, 2]", 0),
    ("['a', 'b']", "['a','b']", 1), ("['a'] junk", "['a']", 0), ("[1, 2.0]", "[1.0, 2]", 1), ("[01]", "[1]", 0),
    ("'x'", "'x'", 1), ("{'k': 1}", "{'k': 1.0}", 1), ("[1,]", "[1]", 1), ("7 ", "+7", 1), ("7.0", "7", 0),
    ("1e1", "10.0", 1), ("[\u0663]", "[3]", 0), ("\u0663", "3", 1), ("\u0663.5", "3.5", 1),
]


def test_numeric_sign(spark):
    df = spark.createDataFrame([(i, v, a) for i, (v, a, _) in enumerate(NUMERIC_CASES)],
                               "i int, v string, a string")
    got = {r.i: r.sign for r in L.score_numeric(df, "v", "a").collect()}
    assert [got[i] for i in range(len(NUMERIC_CASES))] == [e for _, _, e in NUMERIC_CASES]


def test_numeric_fast_path_matches_python_rule(spark):
    for v, a, e in NUMERIC_CASES:
        assert L.python_numeric_sign(v, a) == e, (v, a)


def test_nearest_option_and_block(spark):
    df = spark.createDataFrame([("cat", ["cot", "cat", "cat"]), ("x", ["aa", "bb"])],
                               "a string, c array<string>")
    assert [r[0] for r in df.select(A.nearest_option("a", "c")).collect()] == ["B", "A"]
    blk = spark.createDataFrame([(["x", "y"],)], "c array<string>").select(A.option_block("c")).first()[0]
    assert blk == "A. x\nB. y\n"


CHAIN_CASES = [
    ("Reasoning Steps:\nLook: left\n\n  Count\n", ["Look left", "  Count"]),
    ("Step A: x\nStep B", ["Step A: x", "Step B"]),
    ("reasoning steps", None),
    ("   ", None),
]


def test_parse_steps(spark):
    got = _col(spark, [(t,) for t, _ in CHAIN_CASES], "t string", CH.parse_steps("t"))
    assert got == [e for _, e in CHAIN_CASES]


def test_refusal_is_case_sensitive_and_fallback_parses(spark):
    got = _col(spark, [("I Cannot Answer",), ("Sorry, I cannot answer that.",)], "t string",
               CH.refusal_fallback("t"))
    assert got[0] == "I Cannot Answer"
    assert got[1] == CH.FALLBACK_CHAIN
    steps = _col(spark, [(CH.FALLBACK_CHAIN,)], "t string", CH.parse_steps("t"))[0]
    assert len(steps) == 5 and all(":" not in s for s in steps)


def test_chain_merge(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["only"],)], "c array<string>")
    rows = df.select(CH.context_prompt("c").alias("ctx"), CH.last_instruction("c").alias("last")).collect()
    assert rows[0].ctx.endswith("1. a\n2. b\n") and rows[0].last.endswith("c")
    assert rows[1].ctx == CH.CONTEXT_HEADER + CH.CONTEXT_STEP_LABEL and rows[1].last.endswith("only")


def test_repetition_guard(spark):
    composed = PR.fill(PR.JUDGE_TEMPLATES["free_answer"], answer="a", response="r")
    df = spark.createDataFrame([("x", "go " * 11), ("x", "go " * 12)], "a string, r string")
    got = [(r[0], r[1]) for r in df.select(M.max_word_count(composed), PR.repetition_guard(composed)).collect()]
    assert got == [(10, False), (11, True)]


def test_running_transcript(spark):
    df = spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (1, 3, "r")], "item int, step int, resp string")
    rows = W.running_transcript(df, "item", "step", "resp").orderBy("step").collect()
    assert [r.transcript for r in rows] == ["", "step1:p\n", "step1:p\nstep2:q\n"]


def test_prf_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "t int, p int")
    r = M.binary_prf(df, "t", "p").first()
    assert (r.precision, r.recall, r.f1, r.yes_rate) == (0.0, 0.0, 0.0, 0.0)


def test_perception_task_metrics(spark):
    rows = [("A", "yes", "yes", 1), ("A", "no", "no", 1), ("B", "yes", "yes", 1), ("B", "no", "unclear", 0)]
    df = spark.createDataFrame([("t", p, g, v, s) for p, g, v, s in rows],
                               "task string, pic string, gt string, verdict string, sign int")
    r = M.task_scores(df, "task", "pic", "gt", "verdict", "sign").first()
    assert (r.acc, r.other_num, r.TP, r.TN, r.FP, r.FN) == (0.75, 1, 2, 1, 0, 0)
    assert r.acc_plus == 0.25 and r.score == 100.0


def test_plus_requires_exactly_two(spark):
    df = spark.createDataFrame([("t", "A", 1), ("t", "A", 1), ("t", "A", 1)], "task string, pic string, sign int")
    assert M.plus_accuracy(df, "task", "pic").first().plus_groups == 0


def test_skill_accuracy(spark):
    df = spark.createDataFrame([(["a", "b"], 1), (["a"], 0), (["b", "b"], 1)], "skills array<string>, sign int")
    got = {r.skill: r.accuracy for r in M.multilabel_accuracy(df, "skills").collect()}
    assert got == {"a": 0.5, "b": 1.0}


def test_pair_accuracy(spark):
    df = spark.createDataFrame(list(enumerate([1, 1, 1, 0, 0, 1])), "pos long, sign int")
    r = M.pair_accuracy(df, "pos").first()
    assert (r.correct, r.total) == (1, 3.0) and r.accuracy == pytest.approx(1 / 3)


def test_pair_accuracy_odd_tail(spark):
    df = spark.createDataFrame(list(enumerate([1, 1, 1])), "pos long, sign int")
    r = M.pair_accuracy(df, "pos").first()
    assert (r.correct, r.total) == (1, 1.5)


def test_null_category_left_out_of_categories(spark):
    df = spark.createDataFrame([("x", 1), (None, 0)], "cat string, sign int")
    assert [r.cat for r in M.accuracy_by(df, "cat").collect()] == ["x"]
    assert M.accuracy(df).first().total == 2


def test_media_type_and_base64(spark):
    df = spark.createDataFrame([("/9j/4AAQ",), ("iVBORw0KGgo=",), ("R0lGODlh",), ("%%%",), (None,)], "i string")
    assert [r[0] for r in df.select(PR.media_type("i")).collect()] == [
        "image/jpeg", "image/png", "image/gif", None, None]
    long = spark.createDataFrame([("QUJD" * 40,)], "i string").select(PR.canonical_base64("i")).first()[0]
    assert long == "QUJD" * 40


def test_literal_fallbacks(spark):
    df = spark.createDataFrame([(1, "['a', 'b']"), (2, "('x', 'y')"), (3, "[None, 'z']"), (4, "junk")],
                               "i int, t string")
    got = {r.i: r.v for r in L.parse_string_list(df, "t", "v").collect()}
    assert got == {1: ["a", "b"], 2: ["x", "y"], 3: [None, "z"], 4: None}
    meta = spark.createDataFrame([(1, "{'skills': ['s1', 's2'], 'grade': 3}"), (2, "{'skills': ('t',), }")],
                                 "i int, m string")
    got = {r.i: r.skills for r in L.parse_skills(meta, "m").collect()}
    assert got == {1: ["s1", "s2"], 2: ["t"]}
