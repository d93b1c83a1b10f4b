"""Property tests: Spark rules against short independent Python statements."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from evalspark.functions import literals as L
from evalspark.functions import signs as S

ALPHABET = st.sampled_from(list("abyesno .,()[]:;!*#{}?- \t") + ["YES", "No", "A"])
TEXT = st.lists(ALPHABET, max_size=12).map("".join)


def py_token_sign(verdict: str, answer: str) -> int:
    v = verdict.lower()
    for c in ".()[],:;!*#{}":
        v = v.replace(c, " ")
    v = re.sub(r"\s+", " ", v).strip()
    return int(answer.lower() in v.split(" "))


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(TEXT, st.sampled_from(["yes", "no", "a", "", "b"])), min_size=1, max_size=30))
def test_token_sign_property(spark, pairs):
    df = spark.createDataFrame(pairs, "v string, a string")
    got = [r[0] for r in df.select(S.token_sign("v", "a")).collect()]
    assert got == [py_token_sign(v, a) for v, a in pairs]


NUM = st.one_of(
    st.integers(-10**6, 10**6).map(str),
    st.floats(allow_nan=True, allow_infinity=True, width=32).map(repr),
    st.sampled_from(["1_000", " 7 ", "+3", "0.50", "1e3", "inf", "-Infinity", "nan", "1.5d", "abc",
                     "[1, 2]", "[1,2.0]", "[2, 1]", "(1, 2)", "", "1__0", "_1", "1_"]),
)


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(NUM, NUM), min_size=1, max_size=25))
def test_numeric_sign_property(spark, pairs):
    rows = [(i, v, a) for i, (v, a) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, v string, a string")
    got = {r.i: r.sign for r in L.score_numeric(df, "v", "a").collect()}
    assert [got[i] for i in range(len(rows))] == [L.python_numeric_sign(v, a) for _, v, a in rows]


LISTS = st.recursive(
    st.one_of(st.integers(-10**18, 10**18).map(str), st.sampled_from(["1.0", "-0", "1e3", "01", "inf", "None", "'a'", "\"b'\""])),
    lambda x: st.tuples(st.sampled_from(["[]", "()", "[,]", "[ ]"]), st.lists(x, max_size=3)).map(
        lambda t: t[0][0] + ", ".join(t[1]) + t[0][1:]), max_leaves=6)
TAILS = st.sampled_from(["", "", "", " ", " junk", "]", ", [1]"])


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(LISTS, TAILS, LISTS, st.booleans()), min_size=1, max_size=25))
def test_list_literals_as_in_python(spark, cases):
    rows = [(i, v + t, (v + t) if same else a) for i, (v, t, a, same) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, v string, a string")
    got = {r.i: r.sign for r in L.score_numeric(df, "v", "a").collect()}
    assert [got[i] for i in range(len(rows))] == [L.python_numeric_sign(v, a) for _, v, a in rows]
    lists = {r.i: r.s for r in L.parse_string_list(df, "v", "s").collect()}
    assert [lists[i] for i in range(len(rows))] == [L._list_of_text(v) for _, v, _ in rows]


def test_decided_rows_reach_python_as_nulls(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("1", "1"), ("[1, 2]", "[1,2]"), ("x", "text"), ("2.5", "2.50"), (None, "3")], "v string, a string")
    assert df.where(S.numeric_sign("v", "a").isNull()).count() == 0
    meta = spark.createDataFrame([("{'skills': ['a', 'b'], 'grade': 3}",), ("{}",), (None,)], "m string")
    assert meta.where(~L.skills_decided("m")).count() == 0
    plan = L.parse_skills(meta, "m").select(F.explode_outer("skills").alias("s")).where("s is not null").distinct()
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


DIGITS = st.sampled_from(["0", "7", "12", "\u0663", "\u096a\u096b", "\U0001d7d8", "_", "__", ".", "+", "-", "e", "E5", " ", "\u2003", "x", "\u00b2", "000", "1" * 50])
LONG = st.lists(DIGITS, min_size=1, max_size=8).flatmap(
    lambda parts: st.sampled_from([1, 1, 1, 40, 3000, 100_000]).map(lambda n: "".join(p * (n if i == 0 else 1) for i, p in enumerate(parts))))


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(LONG, LONG, st.booleans()), min_size=1, max_size=8))
def test_numbers_of_any_length_and_script_as_in_python(spark, pairs):
    pairs = [(v, v if same else a) for v, a, same in pairs]
    df = spark.createDataFrame([(i, v, a) for i, (v, a) in enumerate(pairs)], "i int, v string, a string")
    got = {r.i: r.sign for r in L.score_numeric(df, "v", "a").select("i", "sign").collect()}
    assert [got[i] for i in range(len(pairs))] == [L.python_numeric_sign(v, a) for v, a in pairs]


def test_a_million_digits(spark):
    big = "7" * 1_000_000
    pairs = [(big, "12"), (big, big), (big[:-1] + "8", big), (f" +00{big}\n", big), (f"-{big}", big), (f"{big}.0", "1.5"),
             (f"{big}x", "12"), (f"_{big}", "12"), ("0" * 1_000_000, "-0"), ("_".join(big[:300_000]), big[:300_000])]
    df = spark.createDataFrame([(i, v, a) for i, (v, a) in enumerate(pairs)], "i int, v string, a string")
    got = {r.i: r.sign for r in L.score_numeric(df, "v", "a").select("i", "sign").collect()}
    assert [got[i] for i in range(len(pairs))] == [L.python_numeric_sign(v, a) for v, a in pairs] == [0, 1, 0, 1, 0, 0, 0, 0, 1, 1]
