"""Registered queries (one per operator group of the survey) and their oracles.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables. ``ORACLES`` holds the equivalent DuckDB SQL; queries
without one are checked by row count and by pytest goldens.
"""

from __future__ import annotations

import dataclasses

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators import metrics as M
from evalspark.plans import fixture_sql as FX
from evalspark.plans import sqltext as Q
from evalspark.plans import suites as SU
from evalspark.sources import fixtures as D
from evalspark.sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


# ---------------------------------------------------------------------------
# yes/no verdicts, four runs

_D1_SIGN = f"""
s AS (SELECT *, {Q.token_sign('verdict', "CASE WHEN gt_answer = 1 THEN 'yes' ELSE 'no' END")} AS sign FROM d1)
"""


def _hallucination_rows(spark, sf_dir) -> DataFrame:
    return SU.HALLUCINATION.score_rows(D.d1_yes_no(_t(spark, sf_dir)))


@register("overall_accuracy", FX.with_fixtures(
    f""", {_D1_SIGN}
    SELECT run_id, CAST(sum(sign) AS BIGINT) AS correct, count(*) AS total,
           {Q.ratio('sum(sign)', 'count(*)')} AS accuracy
    FROM s GROUP BY run_id""", d1=FX.D1))
def overall_accuracy(spark, sf_dir):
    """A1 + A15: correct / total / accuracy for every run in one aggregate."""
    return M.accuracy(_hallucination_rows(spark, sf_dir), "sign", ["run_id"])


@register("accuracy_by_category", FX.with_fixtures(
    f""", {_D1_SIGN}
    SELECT run_id, subcategory, CAST(sum(sign) AS BIGINT) AS correct, count(*) AS total,
           {Q.ratio('sum(sign)', 'count(*)')} AS accuracy
    FROM s WHERE subcategory IS NOT NULL GROUP BY run_id, subcategory""", d1=FX.D1))
def accuracy_by_category(spark, sf_dir):
    """A2: per-run accuracy by subcategory; null categories left out."""
    return M.accuracy_by(_hallucination_rows(spark, sf_dir), "subcategory", "sign", ["run_id"])


def _prf_sql(truth: str, pred: str, by: str) -> str:
    return f"""SELECT {by},
      CAST(sum(CASE WHEN {truth} = 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
      CAST(sum(CASE WHEN {truth} <> 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
      CAST(sum(CASE WHEN {truth} = 1 AND {pred} <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
      CAST(sum(CASE WHEN {truth} <> 1 AND {pred} <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
      CAST(sum(CASE WHEN {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS predicted_yes,
      count(*) AS total"""


def _prf_metrics_sql(src: str) -> str:
    return f"""SELECT *, {Q.ratio('tp', 'tp + fp', '0.0')} AS precision, {Q.ratio('tp', 'tp + fn', '0.0')} AS recall,
           {Q.ratio('2 * tp', '2 * tp + fp + fn', '0.0')} AS f1, {Q.ratio('predicted_yes', 'total')} AS yes_rate
    FROM ({src})"""


@register("binary_prf", FX.with_fixtures(
    f""", {_D1_SIGN}
    {_prf_metrics_sql(_prf_sql('gt_answer', Q.says_yes('verdict'), 'run_id') + ' FROM s GROUP BY run_id')}""",
    d1=FX.D1))
def binary_prf(spark, sf_dir):
    """A3 + A4: precision / recall / F1 (zero division -> 0) and yes-rate per run."""
    from evalspark.functions.text import says_yes
    rows = D.d1_yes_no(_t(spark, sf_dir))
    return M.binary_prf(rows, "gt_answer", says_yes("verdict"), ["run_id"])


@register("yes_rate", FX.with_fixtures(
    f"""SELECT run_id, {Q.ratio(f"sum({Q.says_yes('verdict')})", 'count(*)')} AS yes_rate
    FROM d1 GROUP BY run_id""", d1=FX.D1))
def yes_rate(spark, sf_dir):
    """A4: share of predicted positives ('yes' inside the verdict) per run."""
    from evalspark.functions.text import says_yes
    rows = D.d1_yes_no(_t(spark, sf_dir))
    return rows.groupBy("run_id").agg(
        F.try_divide(F.sum(says_yes("verdict")).cast("double"), F.count(F.lit(1)).cast("double"))
        .alias("yes_rate"))


def _suite_long_sql(sign_sql: str, cat: str, truth: str, by: str = "run_id") -> str:
    prf = _prf_metrics_sql(_prf_sql(truth, Q.says_yes('verdict'), by) + f" FROM s GROUP BY {by}")
    return f""", s AS (SELECT *, {sign_sql} AS sign FROM d1),
    o AS (SELECT {by}, CAST(sum(sign) AS DOUBLE) AS correct, CAST(count(*) AS DOUBLE) AS total,
                 {Q.ratio('sum(sign)', 'count(*)')} AS accuracy FROM s GROUP BY {by}),
    c AS (SELECT {by}, {cat} AS metric, {Q.ratio('sum(sign)', 'count(*)')} AS value
          FROM s WHERE {cat} IS NOT NULL GROUP BY {by}, {cat}),
    b AS (SELECT {by}, precision, recall, f1, yes_rate FROM ({prf}))
    {Q.unpivot('o', by, ['correct', 'total', 'accuracy'], 'overall')}
    UNION ALL SELECT {by}, 'category' AS metric_group, CAST(metric AS VARCHAR) AS metric, value FROM c
    UNION ALL {Q.unpivot('b', by, ['precision', 'recall', 'f1', 'yes_rate'], 'binary')}"""


_HALLU_SIGN_SQL = Q.token_sign('verdict', "CASE WHEN gt_answer = 1 THEN 'yes' ELSE 'no' END")
_PROBE_SIGN_SQL = Q.token_sign('verdict', Q.py_strip('lower(ground_truth)'))


@register("metrics_long", FX.with_fixtures(
    _suite_long_sql(_HALLU_SIGN_SQL, "subcategory", "gt_answer"), d1=FX.D1))
def metrics_long(spark, sf_dir):
    """Overall, per-category and binary metrics merged into one long table."""
    return SU.HALLUCINATION.report(D.d1_yes_no(_t(spark, sf_dir)), by=["run_id"])


@register("suite_hallucination", FX.with_fixtures(
    _suite_long_sql(_HALLU_SIGN_SQL, "subcategory", "gt_answer"), d1=FX.D1))
def suite_hallucination(spark, sf_dir):
    """yes/no hallucination suite (S6 answers, S2 sign, A1-A4) per run."""
    return SU.HALLUCINATION.report(D.d1_yes_no(_t(spark, sf_dir)), by=["run_id"])


@register("suite_object_probe", FX.with_fixtures(
    _suite_long_sql(_PROBE_SIGN_SQL, "subset", Q.says_yes('ground_truth')), d1=FX.D1))
def suite_object_probe(spark, sf_dir):
    """Object-probing suite (S7 answers, S2 sign, A2 by subset, A3/A4 on 'yes')."""
    return SU.OBJECT_PROBE.report(D.d1_yes_no(_t(spark, sf_dir)), by=["run_id"])


# The sheet's columns: the fixed metrics, then the accuracy of each known category.
_SHEET_CATEGORIES = ["de", "en", "es", "fr"]
_SHEET_METRICS = ["correct", "total", "accuracy", "precision", "recall", "f1", "yes_rate", *_SHEET_CATEGORIES]
_HALLU_LONG_SQL = FX.with_fixtures(_suite_long_sql(_HALLU_SIGN_SQL, "subcategory", "gt_answer"), d1=FX.D1)
_PROBE_LONG_SQL = FX.with_fixtures(
    _suite_long_sql(_PROBE_SIGN_SQL, "subset", Q.says_yes('ground_truth')), d1=FX.D1)


@register("score_sheet_wide", f"""
    PIVOT (SELECT run_id, metric, value FROM ({_HALLU_LONG_SQL}))
    ON metric IN ({", ".join(Q.q(m) for m in _SHEET_METRICS)}) USING max(value) GROUP BY run_id""")
def score_sheet_wide(spark, sf_dir):
    """One row per run, one column per metric and category (pivot with listed values)."""
    long = SU.HALLUCINATION.report(D.d1_yes_no(_t(spark, sf_dir)), by=["run_id"])
    return M.wide_sheet(long, ["run_id"], _SHEET_METRICS)


@register("multi_run_scores", f"""
    SELECT 'hallucination' AS suite, * FROM ({_HALLU_LONG_SQL})
    UNION ALL SELECT 'object_probe' AS suite, * FROM ({_PROBE_LONG_SQL})""")
def multi_run_scores(spark, sf_dir):
    """Two suites for all runs in one job (one scan, one shuffle); ``suite`` and ``run_id`` are keys."""
    rows = D.d1_yes_no(_t(spark, sf_dir))
    return SU.multi_report([SU.HALLUCINATION, SU.OBJECT_PROBE], rows, by=["run_id"])


# ---------------------------------------------------------------------------
# Two questions per picture

from evalspark.functions import signs as S  # noqa: E402
from evalspark.operators import windows as W  # noqa: E402

_TASK_DIM_SQL = "(VALUES " + ", ".join(
    f"({Q.q(task)}, {Q.q(cat)})" for cat, tasks in M.TASK_CATEGORIES.items() for task in tasks
) + ") AS dim(task, eval_type)"

_D2_SIGN = f"""s AS (SELECT *, {Q.token_sign('verdict', 'ground_truth')} AS sign,
                     {Q.ternary('ground_truth')} AS g, {Q.ternary('verdict', True)} AS p FROM d2)"""


def _perception_rows(spark, sf_dir) -> DataFrame:
    return SU.PERCEPTION.score_rows(D.d2_pairs(_t(spark, sf_dir)))


_TERNARY_SQL = FX.with_fixtures(f""", {_D2_SIGN}
    SELECT subset, n, TP, FN, FP, TN, other_num, bad_label, {Q.ratio('hits', 'n')} AS acc,
           {Q.ratio('TP', 'TP + FP', '0.0')} AS precision, {Q.ratio('TP', 'TP + FN', '0.0')} AS recall
    FROM (SELECT subset, count(*) AS n,
            CAST(sum(CASE WHEN g = p THEN 1 ELSE 0 END) AS BIGINT) AS hits,
            CAST(sum(CASE WHEN p <> -1 AND g = 1 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS TP,
            CAST(sum(CASE WHEN p <> -1 AND g = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS FN,
            CAST(sum(CASE WHEN p <> -1 AND g = 0 AND p = 1 THEN 1 ELSE 0 END) AS BIGINT) AS FP,
            CAST(sum(CASE WHEN p <> -1 AND g = 0 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS TN,
            CAST(sum(CASE WHEN p = -1 THEN 1 ELSE 0 END) AS BIGINT) AS other_num,
            CAST(sum(CASE WHEN g IS NULL OR p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_label
          FROM s GROUP BY subset)""", d2=FX.D2)


@register("ternary_confusion", _TERNARY_SQL)
def ternary_confusion(spark, sf_dir):
    """A5 + S10: yes/no/unclear confusion per task (acc over all rows)."""
    return M.ternary_confusion(D.d2_pairs(_t(spark, sf_dir)), "subset", "ground_truth", "verdict")


_PLUS_CORE = f"""pg AS (SELECT subset, picture_name, coalesce(sum(sign), 0) AS s, count(*) AS r
                 FROM s GROUP BY subset, picture_name)"""


@register("plus_accuracy", FX.with_fixtures(f""", {_D2_SIGN}, {_PLUS_CORE}
    SELECT subset, plus_groups, n, groups, {Q.ratio('plus_groups', 'n')} AS acc_plus
    FROM (SELECT subset, CAST(sum(CASE WHEN picture_name IS NOT NULL AND s = 2 THEN 1 ELSE 0 END) AS BIGINT) AS plus_groups,
                 CAST(sum(r) AS BIGINT) AS n, count(picture_name) AS groups FROM pg GROUP BY subset)""", d2=FX.D2))
def plus_accuracy(spark, sf_dir):
    """Pictures with exactly two correct answers, divided by the row count."""
    return M.plus_accuracy(_perception_rows(spark, sf_dir), "subset", "picture_name", "sign")


_TASK_SCORE_CTE = f""", {_D2_SIGN},
    pg AS (SELECT subset, picture_name, count(*) AS r, coalesce(sum(sign), 0) AS s,
              sum(CASE WHEN g = p THEN 1 ELSE 0 END) AS hits,
              sum(CASE WHEN p <> -1 AND g = 1 AND p = 1 THEN 1 ELSE 0 END) AS TP,
              sum(CASE WHEN p <> -1 AND g = 1 AND p = 0 THEN 1 ELSE 0 END) AS FN,
              sum(CASE WHEN p <> -1 AND g = 0 AND p = 1 THEN 1 ELSE 0 END) AS FP,
              sum(CASE WHEN p <> -1 AND g = 0 AND p = 0 THEN 1 ELSE 0 END) AS TN,
              sum(CASE WHEN p = -1 THEN 1 ELSE 0 END) AS other_num
           FROM s GROUP BY subset, picture_name),
    tt AS (SELECT subset, CAST(sum(r) AS BIGINT) AS n, count(picture_name) AS groups,
              CAST(sum(CASE WHEN picture_name IS NOT NULL AND s = 2 THEN 1 ELSE 0 END) AS BIGINT) AS plus_groups,
              CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(TP) AS BIGINT) AS TP, CAST(sum(FN) AS BIGINT) AS FN,
              CAST(sum(FP) AS BIGINT) AS FP, CAST(sum(TN) AS BIGINT) AS TN, CAST(sum(other_num) AS BIGINT) AS other_num
           FROM pg GROUP BY subset),
    ts AS (SELECT subset, n, groups, plus_groups, TP, FN, FP, TN, other_num,
              {Q.ratio('hits', 'n')} AS acc, {Q.ratio('TP', 'TP + FP', '0.0')} AS precision,
              {Q.ratio('TP', 'TP + FN', '0.0')} AS recall, {Q.ratio('plus_groups', 'n')} AS acc_plus,
              {Q.ratio('hits', 'n')} * 100 + {Q.ratio('plus_groups', 'n')} * 100 AS score
           FROM tt)"""


@register("task_score", FX.with_fixtures(f"{_TASK_SCORE_CTE} SELECT * FROM ts", d2=FX.D2))
def task_score(spark, sf_dir):
    """A5-A7 in one scan: per-task confusion, acc_plus and score = 100*acc + 100*acc_plus."""
    return M.task_scores(_perception_rows(spark, sf_dir), "subset", "picture_name",
                         "ground_truth", "verdict", "sign")


_ROLLUP_SQL = f"""{_TASK_SCORE_CTE},
    j AS (SELECT dim.eval_type, ts.subset, ts.score FROM ts JOIN {_TASK_DIM_SQL} ON ts.subset = dim.task)"""


@register("category_total_rollup", FX.with_fixtures(f"""{_ROLLUP_SQL}
    SELECT eval_type, subset, round(score, 9) AS score, 'task' AS level FROM j
    UNION ALL SELECT eval_type, NULL AS subset, round(sum(score), 9) AS score, 'category' AS level
    FROM j GROUP BY eval_type""", d2=FX.D2))
def category_total_rollup(spark, sf_dir):
    """A8 + J5: task scores and category totals in one ``rollup``."""
    scores = task_score(spark, sf_dir)
    dim = M.task_dimension(spark)
    out = M.category_rollup(scores, "subset", dim, "score")
    return out.withColumn("score", F.round("score", 9)).select("eval_type", "subset", "score", "level")


@register("suite_perception", FX.with_fixtures(f"""{_ROLLUP_SQL}
    SELECT 'task_score' AS metric_group, subset AS metric, round(score, 9) AS value FROM j
    UNION ALL SELECT 'category_total' AS metric_group, concat(eval_type, '_total') AS metric,
           round(sum(score), 9) AS value FROM j GROUP BY eval_type""", d2=FX.D2))
def suite_perception(spark, sf_dir):
    """perception/cognition suite (S2 sign, A5-A8) in the long layout."""
    out = SU.PERCEPTION.report(D.d2_pairs(_t(spark, sf_dir)))
    return out.withColumn("value", F.round("value", 9))


@register("task_rows", FX.with_fixtures(f"""
    SELECT d2.subset, dim.eval_type, count(*) AS n_rows
    FROM d2 JOIN {_TASK_DIM_SQL} ON d2.subset = dim.task GROUP BY d2.subset, dim.eval_type""", d2=FX.D2))
def task_rows(spark, sf_dir):
    """P5 + J5: one grouped pass over all tasks (no per-task filter) with categories."""
    rows = D.d2_pairs(_t(spark, sf_dir)).select("subset")
    tagged = M.with_task_category(rows, "subset", M.task_dimension(spark).withColumnRenamed("task", "task"))
    return tagged.groupBy("subset", "eval_type").agg(F.count(F.lit(1)).alias("n_rows"))


_PAIR_SIGN = f"s AS (SELECT *, {Q.contains_sign('choice_verdict', 'correct_answer')} AS sign FROM d2)"
_PAIR_SQL = f""", {_PAIR_SIGN},
    pr AS (SELECT floor(item_no / 2) AS pair, count(*) AS r,
                  sum(CASE WHEN sign = 1 THEN 1 ELSE 0 END) AS ones FROM s GROUP BY floor(item_no / 2)),
    pa AS (SELECT CAST(sum(CASE WHEN r = 2 AND ones = 2 THEN 1 ELSE 0 END) AS BIGINT) AS correct,
                  CAST(sum(r) AS DOUBLE) / 2.0 AS total FROM pr)"""


@register("pair_accuracy", FX.with_fixtures(f"""{_PAIR_SQL}
    SELECT correct, total, {Q.ratio('correct', 'total')} AS accuracy FROM pa""", d2=FX.D2))
def pair_accuracy(spark, sf_dir):
    """A11 + S3: consecutive pairs (0,1), (2,3)... both correct; total = rows / 2."""
    rows = SU.PAIRED_CHOICE.score_rows(D.d2_pairs(_t(spark, sf_dir)), verdict="choice_verdict")
    return M.pair_accuracy(rows, "item_no", "sign")


@register("suite_paired_choice", FX.with_fixtures(f"""{_PAIR_SQL},
    pm AS (SELECT correct, total, {Q.ratio('correct', 'total')} AS accuracy FROM pa)
    {Q.unpivot('pm', '', ['correct', 'total', 'accuracy'], 'pairs')}""", d2=FX.D2))
def suite_paired_choice(spark, sf_dir):
    """Paired-choice suite (S3 containment sign, A11 pairs) in the long layout."""
    return SU.PAIRED_CHOICE.report(D.d2_pairs(_t(spark, sf_dir)), verdict="choice_verdict")


@register("all_correct_groups", FX.with_fixtures(f""", {_D2_SIGN},
    grp AS (SELECT category, subcategory, subset, picture_name, count(*) AS r, coalesce(sum(sign), 0) AS s
            FROM s WHERE category IS NOT NULL AND subcategory IS NOT NULL AND subset IS NOT NULL
              AND picture_name IS NOT NULL
            GROUP BY category, subcategory, subset, picture_name)
    SELECT CAST(sum(CASE WHEN s = r THEN 1 ELSE 0 END) AS BIGINT) AS correct_groups, count(picture_name) AS groups,
           {Q.ratio('sum(CASE WHEN s = r THEN 1 ELSE 0 END)', 'count(*)')} AS group_accuracy FROM grp""",
    d2=FX.D2))
def all_correct_groups(spark, sf_dir):
    """Share of (category, subcategory, set, figure) groups answered fully right."""
    return M.all_correct_groups(_perception_rows(spark, sf_dir),
                                ["category", "subcategory", "subset", "picture_name"], "sign")


@register("row_numbering", FX.with_fixtures("""
    SELECT item_no, subset, row_number() OVER (PARTITION BY subset ORDER BY item_no) - 1 AS position
    FROM d2""", d2=FX.D2))
def row_numbering(spark, sf_dir):
    """Dense 0-based positions per task without one task per group."""
    rows = D.d2_pairs(_t(spark, sf_dir)).select("item_no", "subset")
    return W.dense_positions(rows, "item_no", ["subset"]).select("item_no", "subset", "position")


# ---------------------------------------------------------------------------
# D3: options

from evalspark.functions import answers as AN  # noqa: E402
from evalspark.functions import prompts as PR  # noqa: E402
from evalspark.functions import text as TX  # noqa: E402

_LETTERS = Q.q("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_D3_DIST = "list_transform(choices, lambda c: levenshtein(answer_text, c))"


@register("nearest_option", FX.with_fixtures(f"""
    SELECT item_no, answer_text,
           CASE WHEN len(choices) > 0 THEN substr({_LETTERS}, list_position({_D3_DIST}, list_min({_D3_DIST})), 1) END
             AS nearest
    FROM d3""", d3=FX.D3))
def nearest_option(spark, sf_dir):
    """Letter of the closest choice by edit distance, first on ties."""
    rows = D.d3_options(_t(spark, sf_dir))
    return rows.select("item_no", "answer_text", AN.nearest_option("answer_text", "choices").alias("nearest"))


@register("argmin_first", FX.with_fixtures(f"""
    SELECT item_no, CAST(list_min({_D3_DIST}) AS INTEGER) AS min_distance,
           CAST(list_position({_D3_DIST}, list_min({_D3_DIST})) AS INTEGER) AS argmin
    FROM d3""", d3=FX.D3))
def argmin_first(spark, sf_dir):
    """Position of the smallest distance, the first one on ties."""
    rows = D.d3_options(_t(spark, sf_dir))
    dist = AN.edit_distances("answer_text", "choices")
    return rows.select("item_no", F.array_min(dist).alias("min_distance"),
                       AN.argmin_first(dist).alias("argmin"))


@register("option_block", FX.with_fixtures(f"""
    SELECT item_no, array_to_string(list_transform(choices,
             lambda c, i: concat(substr({_LETTERS}, i, 1), '. ', c, chr(10))), '') AS block
    FROM d3""", d3=FX.D3))
def option_block(spark, sf_dir):
    """The lettered option block shown to the judge."""
    rows = D.d3_options(_t(spark, sf_dir))
    return rows.select("item_no", AN.option_block("choices").alias("block"))


@register("paren_answer", FX.with_fixtures("""
    SELECT item_no, concat('(', lower(answer_letter), ')') AS answer FROM d3""", d3=FX.D3))
def paren_answer(spark, sf_dir):
    """Letter answer -> '(a)'."""
    rows = D.d3_options(_t(spark, sf_dir))
    return rows.select("item_no", TX.paren_letter("answer_letter").alias("answer"))


_D3_SIGN = f"""s AS (SELECT *, {Q.contains_sign('verdict', "concat('(', lower(answer_letter), ')')")} AS sign FROM d3)"""


@register("suite_lettered_choice", FX.with_fixtures(f""", {_D3_SIGN},
    o AS (SELECT CAST(sum(sign) AS DOUBLE) AS correct, CAST(count(*) AS DOUBLE) AS total,
                 {Q.ratio('sum(sign)', 'count(*)')} AS accuracy FROM s)
    {Q.unpivot('o', '', ['correct', 'total', 'accuracy'], 'overall')}
    UNION ALL SELECT 'category' AS metric_group, question_type AS metric, {Q.ratio('sum(sign)', 'count(*)')} AS value
    FROM s WHERE question_type IS NOT NULL GROUP BY question_type""", d3=FX.D3))
def suite_lettered_choice(spark, sf_dir):
    """Lettered-choice suite (S8 answers, S3 sign, A1 + A2 by question type)."""
    return SU.LETTERED_CHOICE.report(D.d3_options(_t(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Numeric and mixed answers

_W = "(user_id + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END)"


@register("numeric_sign_literals", f"""
    SELECT event_id AS item_no, CAST(CASE
        -- tuples, lists and dicts with the same elements are equal, a tuple and a list never are
        WHEN event_id % 8 IN (0, 7) THEN coalesce({_W} = user_id AND value IS NOT NULL, false)
        WHEN event_id % 8 IN (2, 3, 4) THEN {_W} = user_id
        -- a bare word and two lists in a row are no such literal
        ELSE false END AS INTEGER) AS sign
    FROM events""")
def numeric_sign_literals(spark, sf_dir):
    """S4 + F3: Python literals over a row's columns, in spellings that only Python decides."""
    from evalspark.functions.literals import score_numeric
    return score_numeric(D.d4_literals(_t(spark, sf_dir)), "verdict", "answer", "sign").select("item_no", "sign")


@register("numeric_sign", FX.with_fixtures(f"""
    SELECT item_no, {Q.numeric_sign('verdict', 'answer')} AS sign FROM d4""", d4=FX.D4))
def numeric_sign(spark, sf_dir):
    """Typed numeric comparison (int / float / list; text answers never score)."""
    from evalspark.functions.literals import score_numeric
    rows = D.d4_numeric(_t(spark, sf_dir)).select("item_no", "answer", "verdict")
    return score_numeric(rows, "verdict", "answer", "sign").select("item_no", "sign")


_D4_ROUTED = f"""(CASE WHEN question_type = 'multi_choice' THEN {Q.token_sign('verdict', 'answer')}
                  ELSE {Q.numeric_sign('verdict', 'answer')} END)"""


@register("mixed_router", FX.with_fixtures(f"""
    SELECT item_no, question_type, {_D4_ROUTED} AS sign FROM d4""", d4=FX.D4))
def mixed_router(spark, sf_dir):
    """Choice rows -> token sign, other rows -> numeric sign."""
    rows = D.d4_numeric(_t(spark, sf_dir))
    scored = SU.MATH_MIXED.score_rows(rows)
    return scored.select("item_no", "question_type", "sign")


_MATH_DIST = "list_transform(choices, lambda c: levenshtein(answer, c))"


@register("suite_math_mixed", FX.with_fixtures(f""",
    l AS (SELECT *, CASE WHEN question_type = 'multi_choice' AND len(choices) > 0
                         THEN substr({_LETTERS}, list_position({_MATH_DIST}, list_min({_MATH_DIST})), 1)
                         ELSE answer END AS label FROM m),
    s AS (SELECT *, (CASE WHEN question_type = 'multi_choice' THEN {Q.token_sign('verdict', 'label')}
                     ELSE {Q.numeric_sign('verdict', 'label')} END) AS sign FROM l),
    o AS (SELECT CAST(sum(sign) AS DOUBLE) AS correct, CAST(count(*) AS DOUBLE) AS total,
                 {Q.ratio('sum(sign)', 'count(*)')} AS accuracy FROM s)
    {Q.unpivot('o', '', ['correct', 'total', 'accuracy'], 'overall')}
    UNION ALL SELECT 'skill' AS metric_group, skill AS metric, {Q.ratio('sum(sign)', 'count(*)')} AS value
    FROM (SELECT sign, unnest(list_distinct(skills)) AS skill FROM s) GROUP BY skill""", d4=FX.D4, m=FX.D4_MATH))
def suite_math_mixed(spark, sf_dir):
    """Mixed math suite on stored rows: nearest option of literal choices (S11, S13),
    routed signs (S23), overall and per skill of literal metadata (A1, A9, S14)."""
    return SU.MATH_MIXED.report(D.d4_math(_t(spark, sf_dir)))


@register("math_judge_requests", FX.with_fixtures(f""",
    l AS (SELECT *, CASE WHEN question_type = 'multi_choice' THEN 'choice' ELSE 'number' END AS kind,
                 coalesce(array_to_string(list_transform(choices, lambda c, i:
                          concat(substr({_LETTERS}, i, 1), '. ', c, chr(10))), ''), '') AS opts FROM m)
    SELECT item_no, kind, CASE WHEN kind = 'choice'
             THEN {Q.fill(PR.JUDGE_TEMPLATES['choice'], choices='opts', response='verdict')}
             ELSE {Q.fill(PR.JUDGE_TEMPLATES['number'], response='verdict')} END AS request,
           CASE WHEN question_type = 'multi_choice' THEN {Q.token_sign('verdict', f"CASE WHEN len(choices) > 0 THEN substr({_LETTERS}, list_position({_MATH_DIST}, list_min({_MATH_DIST})), 1) ELSE answer END")}
                ELSE {Q.numeric_sign('verdict', 'answer')} END AS sign
    FROM l""", d4=FX.D4, m=FX.D4_MATH))
def math_judge_requests(spark, sf_dir):
    """M16 + M11: the mixed suite's judge pass: option blocks in choice requests (S12),
    kinds by question, signs routed by kind."""
    suite = dataclasses.replace(SU.MATH_MIXED, response=lambda df: F.col("verdict"))
    return SU.judge(D.d4_math(_t(spark, sf_dir)), suite, "verdict").select("item_no", "kind", "request", "sign")


# ---------------------------------------------------------------------------
# Skills metadata

_D5_SKILLS = f"""sk AS (SELECT item_no, sign,
    CAST(json_extract(replace(metadata, chr(39), '"'), '$.skills') AS VARCHAR[]) AS skills FROM d5)"""


def _skill_rows(spark, sf_dir) -> DataFrame:
    from evalspark.functions.literals import parse_skills
    return parse_skills(D.d5_skills(_t(spark, sf_dir)), "metadata", "skills")


@register("skill_accuracy", FX.with_fixtures(f""", {_D5_SKILLS},
    ex AS (SELECT sign, unnest(list_distinct(skills)) AS skill FROM sk)
    SELECT skill, CAST(sum(sign) AS BIGINT) AS correct, count(*) AS total,
           {Q.ratio('sum(sign)', 'count(*)')} AS accuracy FROM ex GROUP BY skill""", d5=FX.D5))
def skill_accuracy(spark, sf_dir):
    """Accuracy per skill, each row counted once per distinct skill."""
    return M.multilabel_accuracy(_skill_rows(spark, sf_dir), "skills", "sign", (), "skill")


@register("distinct_skills", FX.with_fixtures(f""", {_D5_SKILLS}
    SELECT DISTINCT unnest(skills) AS skill FROM sk""", d5=FX.D5))
def distinct_skills(spark, sf_dir):
    """The set of skills over all rows."""
    return M.distinct_labels(_skill_rows(spark, sf_dir), "skills", "skill")


@register("extract_skills", FX.with_fixtures(f""", {_D5_SKILLS}
    SELECT item_no, array_to_string(skills, '|') AS skills_text, CAST(len(skills) AS INTEGER) AS n_skills FROM sk""",
    d5=FX.D5))
def extract_skills(spark, sf_dir):
    """S14 (+S13 fallback): skills list from dict-literal metadata text."""
    rows = _skill_rows(spark, sf_dir)
    return rows.select("item_no", F.array_join("skills", "|").alias("skills_text"),
                       F.size("skills").alias("n_skills"))


# ---------------------------------------------------------------------------
# Chain generations

from evalspark.functions import chains as CH  # noqa: E402

_PARSED = f"""c AS (SELECT item_id, attempt, {Q.parse_steps('generation')} AS steps,
                      {Q.parse_steps(Q.refusal('generation', CH.REFUSAL_PHRASES, CH.FALLBACK_CHAIN))} AS chain,
                      CAST(coalesce({' OR '.join(f"contains(generation, {Q.q(p)})" for p in CH.REFUSAL_PHRASES)}, false) AS INTEGER) AS refused
               FROM d6)"""
_FIRST = f""", {_PARSED},
    fv AS (SELECT item_id, arg_min(chain, attempt) FILTER (WHERE chain IS NOT NULL AND attempt <= 3) AS chain,
                  min(attempt) FILTER (WHERE chain IS NOT NULL AND attempt <= 3) AS chosen_attempt,
                  count(*) AS attempts
           FROM c GROUP BY item_id)"""


def _chains(spark, sf_dir) -> DataFrame:
    rows = D.d6_generations(_t(spark, sf_dir))
    return rows.select("item_id", "attempt", CH.parse_steps("generation").alias("steps"),
                       CH.parse_steps(CH.refusal_fallback("generation")).alias("chain"),
                       CH.is_refusal("generation").cast("int").alias("refused"))


def _first_chains(spark, sf_dir) -> DataFrame:
    return W.first_valid_attempt(_chains(spark, sf_dir), "item_id", "attempt", "chain", 3, "chain")


@register("chain_steps", FX.with_fixtures(f""", {_PARSED}
    SELECT item_id, attempt, CAST(len(steps) AS INTEGER) AS n_steps, array_to_string(steps, chr(10)) AS steps_text,
           CASE WHEN steps IS NULL THEN 'error' ELSE 'ok' END AS status FROM c""", d6=FX.D6))
def chain_steps(spark, sf_dir):
    """Generation text -> step lines (marker/colon rule, blank lines dropped)."""
    c = _chains(spark, sf_dir)
    return c.select("item_id", "attempt", F.size("steps").alias("n_steps"),
                    F.array_join("steps", "\n").alias("steps_text"), CH.chain_status("steps").alias("status"))


@register("refusal_fallback", FX.with_fixtures(f""", {_PARSED}
    SELECT item_id, attempt, refused, CAST(len(chain) AS INTEGER) AS n_steps FROM c""", d6=FX.D6))
def refusal_fallback(spark, sf_dir):
    """Refusals replaced by the fallback chain before parsing."""
    return _chains(spark, sf_dir).select("item_id", "attempt", "refused", F.size("chain").alias("n_steps"))


@register("first_attempt", FX.with_fixtures(f"""{_FIRST}
    SELECT item_id, chosen_attempt, attempts, CASE WHEN chosen_attempt IS NULL THEN 'exhausted' ELSE 'ok' END AS status,
           CAST(len(chain) AS INTEGER) AS n_steps FROM fv""", d6=FX.D6))
def first_attempt(spark, sf_dir):
    """First valid generation of at most three; none -> 'exhausted'."""
    fv = _first_chains(spark, sf_dir)
    return fv.select("item_id", "chosen_attempt", "attempts", "status", F.size("chain").alias("n_steps"))


@register("chain_merge", FX.with_fixtures(f"""{_FIRST}
    SELECT item_id, {Q.context_prompt('chain', CH.CONTEXT_HEADER + CH.CONTEXT_STEP_LABEL)} AS context,
           {Q.last_instruction('chain', CH.LAST_STEP_PREFIX)} AS last_instruction FROM fv""", d6=FX.D6))
def chain_merge(spark, sf_dir):
    """Chain -> numbered context prompt (steps 1..n-1) and final instruction (step n)."""
    fv = _first_chains(spark, sf_dir)
    return fv.select("item_id", CH.context_prompt("chain").alias("context"),
                     CH.last_instruction("chain").alias("last_instruction"))


@register("step_numbering", FX.with_fixtures(f"""{_FIRST}
    SELECT item_id, CAST(generate_subscripts(chain, 1) AS INTEGER) AS step_no, unnest(chain) AS step
    FROM fv WHERE chain IS NOT NULL""", d6=FX.D6))
def step_numbering(spark, sf_dir):
    """One row per chain step with its 1-based number."""
    fv = _first_chains(spark, sf_dir).filter(F.col("chain").isNotNull())
    return W.number_steps(fv, "chain", ["item_id"])


@register("reusable_chain", FX.with_fixtures(f""", {_PARSED}
    SELECT item_id, attempt, CAST(coalesce(len(steps) > 0 AND NOT list_bool_or(list_transform(steps, lambda x: x IS NULL)), false) AS INTEGER) AS reusable
    FROM c""", d6=FX.D6))
def reusable_chain(spark, sf_dir):
    """Stored chain usable as is (non-empty, no null step)."""
    c = _chains(spark, sf_dir)
    return c.select("item_id", "attempt", CH.reusable("steps").cast("int").alias("reusable"))


@register("structured_chain", FX.with_fixtures(f""", {_PARSED}
    SELECT item_id, attempt, CAST(len(steps) AS INTEGER) AS n_steps, array_to_string(steps, chr(10)) AS steps_text FROM c""",
    d6=FX.D6))
def structured_chain(spark, sf_dir):
    """Chain carried as ``{"inference_instruction": [...]}`` JSON and decoded back."""
    c = _chains(spark, sf_dir).select("item_id", "attempt", CH.encode_structured("steps").alias("js"))
    dec = c.select("item_id", "attempt", CH.decode_structured("js").alias("steps"))
    return dec.select("item_id", "attempt", F.size("steps").alias("n_steps"),
                      F.array_join("steps", "\n").alias("steps_text"))


@register("first_element", FX.with_fixtures(f"""{_FIRST}
    SELECT item_id, chain[1] AS first_step FROM fv""", d6=FX.D6))
def first_element(spark, sf_dir):
    """First step of each item's chosen chain."""
    fv = _first_chains(spark, sf_dir)
    return fv.select("item_id", W.nth("chain", 1).alias("first_step"))


# ---------------------------------------------------------------------------
# Step responses per item

from evalspark.operators import joins as J  # noqa: E402
from evalspark.plans import answers as ANS  # noqa: E402
from evalspark.plans import modes as MO  # noqa: E402
from evalspark.plans import responder as RS  # noqa: E402
from evalspark.sources import files as FI  # noqa: E402
from evalspark.sources import keyed as KT  # noqa: E402
from evalspark.sources import runs as RN  # noqa: E402
from evalspark.streaming import incremental as INC  # noqa: E402


def _d7(spark, sf_dir) -> DataFrame:
    return D.d7_steps(_t(spark, sf_dir))


def _items(d7: DataFrame) -> DataFrame:
    return d7.filter(F.col("step") == 1).select("item_id", "prompt", "image", "already_done")


def _last_responses(d7: DataFrame) -> DataFrame:
    return d7.groupBy("item_id").agg(F.max_by("response", "step").alias("response"))


def _step_responses(d7: DataFrame, k: int) -> DataFrame:
    return d7.filter(F.col("step") == k).select("item_id", "response")


def _ready_chains(d7: DataFrame) -> DataFrame:
    """Chain per item = its step texts in step order (bounded by chain length)."""
    s = d7.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("step", "response"))).alias("s"))
    return s.select("item_id", F.transform("s", lambda x: x["response"]).alias("chain"))


def _one_pass(d7: DataFrame) -> DataFrame:
    """Item, its first two step responses, its last response and its chain from one
    aggregate over the steps (a group is one item's steps)."""
    first = F.col("step") == 1
    return d7.groupBy("item_id").agg(
        F.max(F.when(first, F.col("prompt"))).alias("prompt"),
        F.max(F.when(first, F.col("response"))).alias("step1"),
        F.max(F.when(F.col("step") == 2, F.col("response"))).alias("step2"),
        F.max_by("response", "step").alias("response"),
        F.transform(F.sort_array(F.collect_list(F.struct("step", "response"))), lambda x: x["response"]).alias("chain"),
        F.bool_or(first).alias("has_item")).where("has_item")


_D7_BASE = """items AS (SELECT item_id, prompt, image, already_done FROM d7 WHERE step = 1),
    lastr AS (SELECT item_id, arg_max(response, step) AS response FROM d7 GROUP BY item_id),
    step1 AS (SELECT item_id, response FROM d7 WHERE step = 1),
    ready AS (SELECT item_id, list(response ORDER BY step) AS chain FROM d7 GROUP BY item_id)"""
_TRANSCRIPT = """tr AS (SELECT item_id, step, response, pos, max(pos) OVER (PARTITION BY item_id) AS last_pos,
          coalesce(string_agg(line, '') OVER (PARTITION BY item_id ORDER BY step
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS transcript
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY step) AS pos,
                 concat('step', CAST(row_number() OVER (PARTITION BY item_id ORDER BY step) AS VARCHAR), ':',
                        coalesce(response, ''), chr(10)) AS line FROM d7))"""


@register("running_transcript", FX.with_fixtures(f""", {_TRANSCRIPT}
    SELECT item_id, step, transcript FROM tr""", d7=FX.D7))
def running_transcript(spark, sf_dir):
    """Transcript of earlier step responses before each step."""
    d7 = _d7(spark, sf_dir).select("item_id", "step", "response")
    return W.running_transcript(d7, "item_id", "step", "response").select("item_id", "step", "transcript")


def _multi_turn(spark, sf_dir) -> DataFrame:
    d7 = _d7(spark, sf_dir)
    steps = d7.select("item_id", "step", F.col("response").alias("text"), "response")
    return MO.multi_turn_recorded(steps, _items(d7), "item_id", "step", "text", "response")


@register("step_prompt", FX.with_fixtures(f""", {_TRANSCRIPT}
    SELECT item_id, step, {Q.fill(PR.STEP_TEMPLATE, step='response', answers='transcript')} AS step_prompt
    FROM tr WHERE pos < last_pos""", d7=FX.D7))
def step_prompt(spark, sf_dir):
    """S19 + M5: step prompt (step text + transcript so far) for every non-final step."""
    mt = _multi_turn(spark, sf_dir)
    return mt.filter(~F.col("is_last")).select("item_id", "step", "step_prompt")


@register("final_prompt", FX.with_fixtures(f""", {_TRANSCRIPT}
    SELECT tr.item_id, {Q.fill(PR.FINAL_TEMPLATE, question='d.prompt', extracted_info='tr.transcript', output_format='tr.response')} AS final_prompt
    FROM tr JOIN (SELECT item_id, prompt FROM d7 WHERE step = 1) d ON tr.item_id = d.item_id
    WHERE tr.pos = tr.last_pos""", d7=FX.D7))
def final_prompt(spark, sf_dir):
    """S18 + M5: final prompt from question, full transcript and the last step."""
    mt = _multi_turn(spark, sf_dir)
    return mt.filter(F.col("is_last")).select("item_id", "final_prompt")


@register("prefix_prompt", FX.with_fixtures(f"""
    SELECT item_id, concat({Q.q(PR.STEPWISE_PREFIX)}, prompt) AS prompt FROM d7 WHERE step = 1""", d7=FX.D7))
def prefix_prompt(spark, sf_dir):
    """S20 + M2: step-by-step prefix prepended to the question."""
    items = _items(_d7(spark, sf_dir))
    return items.select("item_id", PR.prefixed_prompt("prompt").alias("prompt"))


@register("mode_direct", FX.with_fixtures(f""", {_D7_BASE}
    SELECT i.item_id, i.prompt, r.response, CASE WHEN r.response IS NULL THEN 1 ELSE 0 END AS missing
    FROM items i LEFT JOIN lastr r ON i.item_id = r.item_id
    WHERE i.item_id NOT IN (SELECT item_id FROM items WHERE already_done = 1)""", d7=FX.D7))
def mode_direct(spark, sf_dir):
    """M1 + J3 + J6: pending items -> request payload -> recorded response by key."""
    d7 = _d7(spark, sf_dir)
    items = _items(d7)
    out = MO.direct(items, _last_responses(d7), done=items.filter(F.col("already_done") == 1))
    return out.select("item_id", "prompt", "response", "missing")


_MODE_CHAIN_SQL = f""", {_D7_BASE}, {_PARSED},
    fvc AS (SELECT item_id, arg_min(chain, attempt) FILTER (WHERE chain IS NOT NULL AND attempt <= 3) AS chain
            FROM c GROUP BY item_id),
    st AS (SELECT i.item_id, i.prompt, f.chain, s1.response AS intermediate_response,
                  {Q.last_instruction('f.chain', CH.LAST_STEP_PREFIX)} AS output_format
           FROM items i JOIN fvc f ON i.item_id = f.item_id LEFT JOIN step1 s1 ON i.item_id = s1.item_id)
    SELECT st.item_id, CAST(len(st.chain) AS INTEGER) AS n_steps, st.intermediate_response,
           {Q.fill(PR.FINAL_TEMPLATE, question='st.prompt', extracted_info='st.intermediate_response', output_format='st.output_format')} AS final_prompt,
           r.response, CASE WHEN r.response IS NULL THEN 1 ELSE 0 END AS missing
    FROM st LEFT JOIN lastr r ON st.item_id = r.item_id"""


@register("mode_chain", FX.with_fixtures(_MODE_CHAIN_SQL, d7=FX.D7, d6=FX.D6))
def mode_chain(spark, sf_dir):
    """M3 (+M7 stage): generated chains -> extract stage -> final stage, joined once by key."""
    t = _t(spark, sf_dir)
    chains = MO.parse_generations(D.d6_generations(t))
    recorded = _one_pass(_d7(spark, sf_dir)).withColumnRenamed("step1", "intermediate_response").drop("chain")
    out = MO.answer_recorded(recorded, chains)
    return out.select("item_id", F.size("chain").alias("n_steps"), "intermediate_response",
                      "final_prompt", "response", "missing")


@register("mode_ready", FX.with_fixtures(f""", {_D7_BASE},
    st AS (SELECT i.item_id, i.prompt, rd.chain, s1.response AS intermediate_response,
                  {Q.last_instruction('rd.chain', CH.LAST_STEP_PREFIX)} AS output_format
           FROM items i JOIN ready rd ON i.item_id = rd.item_id LEFT JOIN step1 s1 ON i.item_id = s1.item_id)
    SELECT st.item_id, CAST(len(st.chain) AS INTEGER) AS n_steps, st.intermediate_response,
           {Q.fill(PR.FINAL_TEMPLATE, question='st.prompt', extracted_info='st.intermediate_response', output_format='st.output_format')} AS final_prompt,
           r.response, CASE WHEN r.response IS NULL THEN 1 ELSE 0 END AS missing
    FROM st LEFT JOIN lastr r ON st.item_id = r.item_id""", d7=FX.D7))
def mode_ready(spark, sf_dir):
    """M4: supplied chains -> extract stage -> final stage (two calls per item), one scan."""
    staged = _one_pass(_d7(spark, sf_dir)).withColumn("intermediate_response", F.col("step1"))
    return staged.select(
        "item_id", F.size("chain").alias("n_steps"), "intermediate_response",
        PR.final_prompt(F.col("prompt"), F.col("intermediate_response"), CH.last_instruction("chain")).alias("final_prompt"),
        "response", F.col("response").isNull().cast("int").alias("missing"))


@register("mode_exchange", FX.with_fixtures(f""", {_D7_BASE},
    other AS (SELECT item_id, concat(response, chr(10), role) AS info FROM d7 WHERE step = 2 AND item_id % 7 <> 0),
    st AS (SELECT i.item_id, i.prompt, rd.chain, o.info
           FROM items i JOIN ready rd ON i.item_id = rd.item_id LEFT JOIN other o ON i.item_id = o.item_id)
    SELECT st.item_id, st.info AS exchange_text,
           {Q.fill(PR.FINAL_TEMPLATE, question='st.prompt', extracted_info='st.info', output_format=Q.last_instruction('st.chain', CH.LAST_STEP_PREFIX))} AS final_prompt,
           r.response, CASE WHEN r.response IS NULL THEN 1 ELSE 0 END AS missing
    FROM st LEFT JOIN lastr r ON st.item_id = r.item_id""", d7=FX.D7))
def mode_exchange(spark, sf_dir):
    """M6 + J2: another model's run, registered as a table of its own and resolved by its id,
    feeds this run's final prompt. Some items are absent from it, some are there twice."""
    d7 = _d7(spark, sf_dir)
    second = d7.where((F.col("step") == 2) & (F.col("item_id") % 7 != 0))
    info = second.select("item_id", F.lit(2).alias("try"), F.col("response").alias("m1_intermediate_response"),
                         F.col("role").alias("m1_intermediate_response_role"), F.lit("unused").alias("m1_response"))
    again = info.where(F.col("item_id") % 5 == 0).withColumns({"try": F.lit(1), "m1_intermediate_response": F.lit("draft")})
    registry = RN.RunRegistry(spark, INC.new_run_folder(spark, "runs"))
    other = registry.add(info.unionByName(again), "m1", "conversations", "ready_chain")
    out = MO.exchange(_items(d7), _ready_chains(d7), registry.load(other), _last_responses(d7), order="try")
    return out.select("item_id", F.array_join("exchange_info", "\n").alias("exchange_text"),
                      "final_prompt", "response", "missing")


@register("align_responses", FX.with_fixtures(f""", {_D7_BASE}
    SELECT i.item_id, i.prompt, r.response FROM lastr r JOIN items i ON r.item_id = i.item_id""", d7=FX.D7))
def align_responses(spark, sf_dir):
    """Responses next to the items they answer, by key."""
    d7 = _d7(spark, sf_dir)
    return J.align(_last_responses(d7), _items(d7)).select("item_id", "prompt", "response")


_KEYED_BUCKETS = 16


@register("keyed_alignment", FX.with_fixtures(f""", {_D7_BASE}
    SELECT i.item_id, i.prompt, r.response FROM lastr r JOIN items i ON r.item_id = i.item_id
    WHERE i.item_id NOT IN (SELECT item_id FROM items WHERE already_done = 1)""", d7=FX.D7))
def keyed_alignment(spark, sf_dir):
    """J1 + J3 on tables bucketed by item: resume and align read them bucket by bucket, without a shuffle."""
    d7 = _d7(spark, sf_dir)
    folder = INC.new_run_folder(spark, "keyed")
    name = "t_" + folder.rsplit("-", 1)[-1]

    def keyed(df: DataFrame, part: str) -> DataFrame:
        return KT.write_keyed(df, f"{name}_{part}", f"{folder}/{part}", "item_id", _KEYED_BUCKETS)

    items = keyed(_items(d7).select("item_id", "prompt", "already_done"), "items")
    responses = keyed(_last_responses(d7), "responses")
    done = items.where("already_done = 1")
    return J.align(responses, J.pending(items, done)).select("item_id", "prompt", "response")


_SCRATCH_SQL = f""", {_D7_BASE},
    g AS (SELECT item_id, attempt, {Q.parse_steps(Q.refusal('generation', CH.REFUSAL_PHRASES, CH.FALLBACK_CHAIN))} AS chain FROM d7g),
    fvs AS (SELECT item_id, arg_min(chain, attempt) FILTER (WHERE chain IS NOT NULL) AS chain,
                   min(attempt) FILTER (WHERE chain IS NOT NULL) AS chosen_attempt FROM g GROUP BY item_id),
    sx AS (SELECT item_id, unnest(generate_series(1, len(chain) - 1)) AS step FROM fvs WHERE chain IS NOT NULL),
    ts AS (SELECT sx.item_id, string_agg(concat('step', sx.step::VARCHAR, ':', coalesce(d7.response, ''), chr(10)), '' ORDER BY sx.step) AS transcript
           FROM sx LEFT JOIN d7 ON d7.item_id = sx.item_id AND d7.step = sx.step GROUP BY sx.item_id)
    SELECT i.item_id, CASE WHEN f.chain IS NULL THEN 'exhausted' ELSE 'ok' END AS status, f.chosen_attempt,
           CASE WHEN f.chain IS NOT NULL THEN {Q.fill(PR.FINAL_TEMPLATE, question='i.prompt', extracted_info='t.transcript', output_format='f.chain[-1]')} END AS final_prompt,
           CASE WHEN f.chain IS NOT NULL THEN r.response END AS response
    FROM items i JOIN fvs f ON i.item_id = f.item_id LEFT JOIN ts t ON t.item_id = i.item_id
    LEFT JOIN lastr r ON r.item_id = i.item_id"""


@register("mode_multi_turn_scratch", FX.with_fixtures(_SCRATCH_SQL, d7=FX.D7, d7g=FX.D7_GENERATIONS))
def mode_multi_turn_scratch(spark, sf_dir):
    """M5 from scratch: chains are generated, asked step by step, stopped after the second
    step and resumed from the stored answers."""
    t = _t(spark, sf_dir)
    d7 = _d7(spark, sf_dir)
    chains = D.d7_generations(t).select(
        MO.request_id("item_id", F.concat(F.lit("c"), F.col("attempt").cast("string"))).alias("request_id"),
        F.col("generation").alias("response"))
    told = d7.select(MO.request_id("item_id", F.concat(F.lit("s"), F.col("step").cast("string"))).alias("request_id"), "response")
    told = told.unionByName(_last_responses(d7).select(MO.request_id("item_id", "f").alias("request_id"), "response"))
    items = _items(d7).select("item_id", "prompt")
    folder = INC.new_run_folder(spark, "answers")

    def run(stop_after: int | None) -> DataFrame:
        return MO.multi_turn_scratch(items, RS.recorded(chains), RS.recorded(told), ANS.AnswerTable(spark, folder),
                                     stop_after=stop_after)

    run(2)
    return run(None).select("item_id", "status", "chosen_attempt", F.col("query").alias("final_prompt"), "response")


@register("resume_pending", FX.with_fixtures(f""", {_D7_BASE}
    SELECT item_id, prompt FROM items WHERE item_id NOT IN (SELECT item_id FROM items WHERE already_done = 1)""",
    d7=FX.D7))
def resume_pending(spark, sf_dir):
    """Items still to run, by anti-join with the finished ones."""
    items = _items(_d7(spark, sf_dir))
    return J.pending(items, items.filter(F.col("already_done") == 1)).select("item_id", "prompt")


_FILL_SQL = f""", {_D7_BASE}, {_PARSED},
    fvc AS (SELECT item_id, arg_min(chain, attempt) FILTER (WHERE chain IS NOT NULL AND attempt <= 3) AS chain
            FROM c GROUP BY item_id)"""
_REUSABLE = "coalesce(len({0}) > 0 AND NOT list_bool_or(list_transform({0}, lambda x: x IS NULL)), false)"


@register("fill_missing_chain", FX.with_fixtures(f"""{_FILL_SQL},
    base AS (SELECT i.item_id, CASE WHEN i.already_done = 1 THEN rd.chain END AS old, f.chain AS new
             FROM items i LEFT JOIN ready rd ON i.item_id = rd.item_id LEFT JOIN fvc f ON i.item_id = f.item_id)
    SELECT item_id,
           CASE WHEN {_REUSABLE.format('old')} THEN 'existing' WHEN new IS NOT NULL THEN 'generated' ELSE 'none' END AS chain_source,
           CAST(len(CASE WHEN {_REUSABLE.format('old')} THEN old ELSE new END) AS INTEGER) AS n_steps
    FROM base""", d7=FX.D7, d6=FX.D6))
def fill_missing_chain(spark, sf_dir):
    """Keep reusable stored chains, fill the others from generated ones."""
    d7 = _d7(spark, sf_dir)
    items = _items(d7).join(_ready_chains(d7), "item_id", "left").withColumn(
        "old", F.when(F.col("already_done") == 1, F.col("chain")))
    gen = MO.parse_generations(D.d6_generations(_t(spark, sf_dir)))
    out = J.fill_missing(items.drop("chain"), gen, "item_id", "old", "chain", "chain")
    return out.select("item_id", "chain_source", F.size("chain").alias("n_steps"))


@register("enrich_chain", FX.with_fixtures(f"""{_FILL_SQL},
    base AS (SELECT f.item_id, rd.chain AS old, f.chain AS new FROM fvc f LEFT JOIN ready rd ON f.item_id = rd.item_id)
    SELECT item_id,
           CASE WHEN {_REUSABLE.format('old')} THEN 'existing' WHEN new IS NOT NULL THEN 'generated' ELSE 'none' END AS chain_source,
           CAST(len(CASE WHEN {_REUSABLE.format('old')} THEN old ELSE new END) AS INTEGER) AS n_steps
    FROM base""", d7=FX.D7, d6=FX.D6))
def enrich_chain(spark, sf_dir):
    """M9 (+P6, S28, J4): give every benchmark item a chain, generating only the gaps."""
    d7 = _d7(spark, sf_dir)
    gen = MO.parse_generations(D.d6_generations(_t(spark, sf_dir)))
    base = gen.select("item_id").join(_ready_chains(d7).withColumnRenamed("chain", "old"), "item_id", "left")
    out = J.fill_missing(base, gen, "item_id", "old", "chain", "chain")
    return out.select("item_id", "chain_source", F.size("chain").alias("n_steps"))


_VISUAL_OLD = "CASE WHEN i.already_done = 1 THEN rd.chain END"


@register("enrich_chain_visual", FX.with_fixtures(f""", {_D7_BASE},
    g AS (SELECT item_id, generation, {Q.parse_steps(Q.refusal('generation', CH.REFUSAL_PHRASES, CH.FALLBACK_CHAIN))} AS rules
          FROM d7g WHERE attempt = 1),
    base AS (SELECT i.item_id, {_VISUAL_OLD} AS old, CASE WHEN g.rules IS NOT NULL THEN g.rules
                    WHEN i.item_id % 12 <> 0 THEN [concat('step for ', i.item_id::VARCHAR), 'answer'] END AS new
             FROM items i LEFT JOIN ready rd ON i.item_id = rd.item_id JOIN g ON i.item_id = g.item_id)
    SELECT item_id,
           CASE WHEN {_REUSABLE.format('old')} THEN 'existing' WHEN new IS NOT NULL THEN 'generated' ELSE 'none' END AS chain_source,
           array_to_string(CASE WHEN {_REUSABLE.format('old')} THEN old ELSE new END, chr(10)) AS chain
    FROM base""", d7=FX.D7, d7g=FX.D7_GENERATIONS))
def enrich_chain_visual(spark, sf_dir):
    """M9 with the image (+J4, S24, S26, W2): stored chains stay, the others come from question
    and image; texts that do not parse are asked for again as structured output."""
    t = _t(spark, sf_dir)
    d7 = _d7(spark, sf_dir)
    items = _items(d7).join(_ready_chains(d7), "item_id", "left").withColumn(
        "old_chain", F.when(F.col("already_done") == 1, F.col("chain"))).drop("chain")
    first = D.d7_generations(t).where("attempt = 1").select(
        MO.request_id("item_id", "v1").alias("request_id"), F.col("generation").alias("response"))
    steps = F.array(F.concat(F.lit("step for "), F.col("item_id").cast("string")), F.lit("answer"))
    second = items.select(MO.request_id("item_id", "v2").alias("request_id"), F.when(
        F.col("item_id") % 12 != 0, CH.encode_structured(steps)).otherwise(F.lit("no json")).alias("response"))
    table = ANS.AnswerTable(spark, INC.new_run_folder(spark, "answers"))
    out = MO.enrich(items, RS.recorded(first), table, visual=True, structured=RS.recorded(second))
    return out.select("item_id", "chain_source", F.array_join("chain", "\n").alias("chain"))


@register("missing_chain", FX.with_fixtures(f"""{_FILL_SQL}
    SELECT item_id FROM fvc WHERE chain IS NULL OR len(chain) = 0""", d7=FX.D7, d6=FX.D6))
def missing_chain(spark, sf_dir):
    """Items whose chain is absent or empty after generation."""
    gen = MO.parse_generations(D.d6_generations(_t(spark, sf_dir)))
    return gen.filter(J.missing_chain(gen, "chain")).select("item_id")


@register("append_results", FX.with_fixtures(f""", {_D7_BASE}
    SELECT item_id, prompt, NULL AS response, NULL AS missing, 'prior' AS batch FROM items WHERE already_done = 1
    UNION ALL
    SELECT i.item_id, i.prompt, r.response, CASE WHEN r.response IS NULL THEN 1 ELSE 0 END AS missing, 'new' AS batch
    FROM items i LEFT JOIN lastr r ON i.item_id = r.item_id
    WHERE i.item_id NOT IN (SELECT item_id FROM items WHERE already_done = 1)""", d7=FX.D7))
def append_results(spark, sf_dir):
    """New results appended to prior ones by column name (absent columns null)."""
    d7 = _d7(spark, sf_dir)
    items = _items(d7)
    prior = items.filter(F.col("already_done") == 1).select("item_id", "prompt", F.lit("prior").alias("batch"))
    new = (MO.direct(items, _last_responses(d7), done=items.filter(F.col("already_done") == 1))
           .select("item_id", "prompt", "response", "missing", F.lit("new").alias("batch")))
    return J.append(prior, new)


@register("completeness", FX.with_fixtures("""
    SELECT e.expected, coalesce(a.actual, 0) AS actual, CASE WHEN e.expected = coalesce(a.actual, 0) THEN 1 ELSE 0 END AS complete
    FROM (SELECT count(DISTINCT item_id) AS expected FROM d7) e,
         (SELECT count(DISTINCT item_id) AS actual FROM d7 WHERE role = 'assistant') a""", d7=FX.D7))
def completeness(spark, sf_dir):
    """Expected items vs items that have a stored result."""
    d7 = _d7(spark, sf_dir)
    return J.completeness(d7.select("item_id"), d7.filter(F.col("role") == "assistant"), "item_id")


@register("project_no_image", FX.with_fixtures("""
    SELECT item_id, step, role, response, prompt, already_done FROM d7""", d7=FX.D7))
def project_no_image(spark, sf_dir):
    """Result rows without the image column."""
    return J.drop_heavy(_d7(spark, sf_dir))


def _positions(spark, sf_dir) -> DataFrame:
    items = _items(_d7(spark, sf_dir)).select("item_id")
    return W.dense_positions(items, "item_id")


_POS_SQL = """, pos AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS position FROM d7 WHERE step = 1)"""


@register("slice_from", FX.with_fixtures(f"""{_POS_SQL}
    SELECT item_id, position FROM pos
    WHERE position >= (SELECT count(*) FROM d7 WHERE step = 1 AND already_done = 1)""", d7=FX.D7))
def slice_from(spark, sf_dir):
    """The tail after as many rows as are already done (dense order key)."""
    items = _items(_d7(spark, sf_dir))
    return J.slice_after_done(_positions(spark, sf_dir), "position", items.filter(F.col("already_done") == 1))


@register("stored_positions", FX.with_fixtures(f"""{_POS_SQL}
    SELECT item_id, position, CAST(floor(position / 16) AS BIGINT) AS batch_id FROM pos
    WHERE position >= (SELECT count(*) FROM d7 WHERE step = 1 AND already_done = 1)""", d7=FX.D7))
def stored_positions(spark, sf_dir):
    """P2 + P4 on a stored item table: places from the files themselves, no numbering at all."""
    path = f"{INC.new_run_folder(spark, 'items')}/items"
    items = _items(_d7(spark, sf_dir)).select("item_id", "already_done")
    items.repartitionByRange("item_id").sortWithinPartitions("item_id").write.parquet(path)
    placed = FI.positioned(spark, path)
    tail = J.slice_after_done(placed, "position", items.where("already_done = 1"))
    return J.batch_ids(tail, "position", 16).select("item_id", "position", "batch_id")


@register("point_lookup", FX.with_fixtures("""
    SELECT item_id, prompt, image FROM d7 WHERE step = 1 AND item_id = 7""", d7=FX.D7))
def point_lookup(spark, sf_dir):
    """One item's prompt and image by key (filter pushed to the scan)."""
    return J.lookup(_items(_d7(spark, sf_dir)), "item_id", 7)


@register("batch_ids", FX.with_fixtures(f"""{_POS_SQL}
    SELECT item_id, position, CAST(floor(position / 16) AS BIGINT) AS batch_id FROM pos""", d7=FX.D7))
def batch_ids(spark, sf_dir):
    """Batches of 16 consecutive items."""
    return J.batch_ids(_positions(spark, sf_dir), "position", 16)


# ---------------------------------------------------------------------------
# Judge inputs

_KINDS = list(PR.JUDGE_TEMPLATES)


def _sql_case(kind: str, values: dict[str, str]) -> str:
    return "(CASE " + " ".join(f"WHEN {kind} = {Q.q(k)} THEN {v}" for k, v in values.items()) + " END)"


_SQL_REQUEST = _sql_case("kind", {k: Q.fill(t, response="response", answer="answer", choices="options")
                                  for k, t in PR.JUDGE_TEMPLATES.items()})
_SQL_INSTR = _sql_case("kind", {k: Q.q(v) for k, v in PR.JUDGE_INSTRUCTIONS.items()})
_SQL_COMPOSED = Q.fill(PR.JUDGE_TEMPLATES["free_answer"], answer="answer", response="response")
_SQL_MAXREP = f"CAST(list_max(map_values(list_histogram(string_split({{0}}, ' ')))) AS INTEGER)"
_D8_GUARD = f"""g AS (SELECT *, {_SQL_MAXREP.format(_SQL_COMPOSED)} AS max_repeat FROM d8)"""


def _d8_guarded(spark, sf_dir) -> DataFrame:
    d8 = D.d8_judge(_t(spark, sf_dir))
    composed = PR.fill(PR.JUDGE_TEMPLATES["free_answer"], answer="answer", response="response")
    return (d8.withColumn("max_repeat", M.max_word_count(composed))
              .withColumn("guarded", (F.col("kind") == "free_answer") & (F.col("max_repeat") > PR.REPEAT_LIMIT)))


def _d8_guard_only(spark, sf_dir) -> DataFrame:
    """The guard flag alone: the word count is evaluated for free-answer rows only."""
    d8 = D.d8_judge(_t(spark, sf_dir))
    composed = PR.fill(PR.JUDGE_TEMPLATES["free_answer"], answer="answer", response="response")
    guarded = (F.when(F.col("kind") == "free_answer", PR.repetition_guard(composed))
                .otherwise(F.lit(False)))
    return d8.withColumn("guarded", guarded)


@register("judge_requests", FX.with_fixtures(f""", {_D8_GUARD}
    SELECT item_no, kind, {_SQL_INSTR} AS instruction, {_SQL_REQUEST} AS request
    FROM g WHERE NOT (kind = 'free_answer' AND max_repeat > {PR.REPEAT_LIMIT})""", d8=FX.D8))
def judge_requests(spark, sf_dir):
    """S21 (+S22): one judge request per row by kind; guarded rows need no call."""
    g = _d8_guard_only(spark, sf_dir).filter(~F.col("guarded"))
    return g.select("item_no", "kind", PR.judge_instruction("kind").alias("instruction"),
                    PR.judge_text("kind", F.col("response"), F.col("answer"), F.col("options")).alias("request"))


@register("judge_pass", FX.with_fixtures(f""", {_D8_GUARD},
    v AS (SELECT item_no, kind, answer,
                 CASE WHEN kind = 'free_answer' AND max_repeat > {PR.REPEAT_LIMIT} THEN 'unclear' ELSE verdict END AS verdict
          FROM g)
    SELECT item_no, kind, verdict,
           CASE WHEN kind IN ('yes_no', 'choice') THEN {Q.token_sign('verdict', 'answer')}
                WHEN kind = 'number' THEN {Q.numeric_sign('verdict', 'answer')}
                ELSE CAST(coalesce(verdict = 'correct', false) AS INTEGER) END AS sign
    FROM v""", d8=FX.D8))
def judge_pass(spark, sf_dir):
    """Verdict for every row (guard or recorded judge output) and its sign by kind."""
    return SU.judge(D.d8_judge(_t(spark, sf_dir)), SU.BY_KIND, "verdict").select("item_no", "kind", "verdict", "sign")


_KIND_SIGN = f"""CASE WHEN kind = 'yes_no' THEN {Q.token_sign('verdict', 'answer')}
                WHEN kind = 'choice' THEN {Q.contains_sign('verdict', 'answer')}
                WHEN kind = 'number' THEN {Q.numeric_sign('verdict', 'answer')}
                ELSE CAST(coalesce(verdict = 'correct', false) AS INTEGER) END"""


@register("judge_all_kinds", FX.with_fixtures(f""", {_D8_GUARD},
    v AS (SELECT item_no, kind, answer, {_SQL_REQUEST} AS request, item_no % 9 = 0 AS failed,
                 coalesce(kind = 'free_answer' AND max_repeat > {PR.REPEAT_LIMIT}, false) AS guarded,
                 CASE WHEN kind = 'free_answer' AND max_repeat > {PR.REPEAT_LIMIT} THEN 'unclear'
                      WHEN item_no % 9 = 0 THEN NULL
                      WHEN kind = 'choice' THEN concat('It is ', upper(answer), '!')
                      WHEN kind = 'number' THEN concat(' +', (item_no % 100)::VARCHAR) ELSE verdict END AS verdict
          FROM (SELECT * REPLACE (CASE WHEN kind = 'number' THEN (item_no % 50)::VARCHAR ELSE answer END AS answer) FROM g)
          WHERE item_no % 6 <> 5)
    SELECT item_no, kind, request, verdict, CASE WHEN failed AND NOT guarded THEN 'timeout' END AS error,
           CASE WHEN failed AND NOT guarded THEN 0 ELSE coalesce({_KIND_SIGN}, 0) END AS sign
    FROM v""", d8=FX.D8))
def judge_all_kinds(spark, sf_dir):
    """M11 + F1: one judge pass over yes/no, choice, number and free-answer rows; each has
    its kind's rule (the suite's own for its kind), with replies, errors, guard and done rows."""
    rows = D.d8_judge(_t(spark, sf_dir)).withColumn("answer", F.when(
        F.col("kind") == "number", (F.col("item_no") % 50).cast("string")).otherwise(F.col("answer")))
    failed, kind = F.col("item_no") % 9 == 0, F.col("kind")
    reply = (F.when(kind == "choice", F.concat(F.lit("It is "), F.upper("answer"), F.lit("!")))
             .when(kind == "number", F.concat(F.lit(" +"), (F.col("item_no") % 100).cast("string"))).otherwise(F.col("verdict")))
    replies = rows.select("item_no", F.when(~failed, reply).alias("response"), F.when(failed, F.lit("timeout")).alias("error"))
    suite = SU.Suite("choices_and_more", answer=lambda df: F.col("answer"), sign=SU._column_sign(S.contains_sign),
                     metrics=SU.summary("kind"), kind="choice", choices=lambda df: F.col("options"))
    return SU.judge(rows.drop("verdict"), suite, replies, done=rows.where("item_no % 6 = 5")).select(
        "item_no", "kind", "request", "verdict", "error", "sign")


@register("judge_live", FX.with_fixtures(f""",
    r AS (SELECT item_no, CASE WHEN gt_answer = 1 THEN 'yes' ELSE 'no' END AS answer,
                 length(concat({Q.q(PR.JUDGE_INSTRUCTIONS['yes_no'])}, chr(10), {Q.fill(PR.JUDGE_TEMPLATES['yes_no'], response='verdict')})) % 3 AS k
          FROM d1)
    SELECT item_no, CASE k WHEN 1 THEN 'Yes.' WHEN 2 THEN 'no' END AS verdict,
           CASE k WHEN 0 THEN 'TimeoutError: no answer' END AS error,
           CASE k WHEN 0 THEN 0 ELSE {Q.token_sign("CASE k WHEN 1 THEN 'Yes.' ELSE 'no' END", 'answer')} END AS sign
    FROM r""", d1=FX.D1))
def judge_live(spark, sf_dir):
    """M11 + F2: a judge called once per row through stored answers: a first run judges some
    rows and stops, the next one asks for the others only and reads the rest."""
    rows = D.d1_yes_no(_t(spark, sf_dir)).withColumnRenamed("verdict", "response").select("item_no", "gt_answer", "response")
    folder = INC.new_run_folder(spark, "answers")

    def by_length(query: str) -> str:
        """A stand-in for a judge model: its verdict follows from the length of the request."""
        if len(query) % 3 == 0:
            raise TimeoutError("no answer")
        return "Yes." if len(query) % 3 == 1 else "no"

    judge = ANS.Call(by_length, parallelism=spark.sparkContext.defaultParallelism)
    SU.judge(rows.where("item_no % 3 = 0"), SU.HALLUCINATION, judge, answers=ANS.AnswerTable(spark, folder))
    return SU.judge(rows, SU.HALLUCINATION, judge, answers=ANS.AnswerTable(spark, folder)).select(
        "item_no", "verdict", "error", "sign")


@register("repetition_guard", FX.with_fixtures(f""", {_D8_GUARD}
    SELECT item_no, max_repeat, CAST(kind = 'free_answer' AND max_repeat > {PR.REPEAT_LIMIT} AS INTEGER) AS guarded
    FROM g""", d8=FX.D8))
def repetition_guard(spark, sf_dir):
    """Largest word repeat in the composed free-answer text; > 10 -> 'unclear'."""
    g = _d8_guarded(spark, sf_dir)
    return g.select("item_no", "max_repeat", F.col("guarded").cast("int").alias("guarded"))


@register("word_frequency", FX.with_fixtures(f"""
    SELECT item_no, {_SQL_MAXREP.format('response')} AS max_count FROM d8""", d8=FX.D8))
def word_frequency(spark, sf_dir):
    """Most frequent space-separated word count per whole response."""
    d8 = D.d8_judge(_t(spark, sf_dir))
    return d8.select("item_no", M.max_word_count("response").alias("max_count"))


@register("exact_verdict", FX.with_fixtures("""
    SELECT item_no, CAST(coalesce(verdict = 'correct', false) AS INTEGER) AS sign FROM d8""", d8=FX.D8))
def exact_verdict(spark, sf_dir):
    """Free-answer sign, verdict exactly 'correct' (case-sensitive)."""
    d8 = D.d8_judge(_t(spark, sf_dir))
    return d8.select("item_no", S.exact_sign("verdict").alias("sign"))


# ---------------------------------------------------------------------------
# Request payloads

_SQL_MEDIA = """(CASE WHEN starts_with(hex(from_base64(image)), 'FFD8FF') THEN 'image/jpeg'
     WHEN starts_with(hex(from_base64(image)), '89504E470D0A1A0A') THEN 'image/png'
     WHEN starts_with(hex(from_base64(image)), '474946383761') OR starts_with(hex(from_base64(image)), '474946383961') THEN 'image/gif'
     WHEN starts_with(hex(from_base64(image)), '52494646') AND substr(hex(from_base64(image)), 17, 8) = '57454250' THEN 'image/webp' END)"""
_SQL_SYS = """CASE WHEN system_text <> '' THEN concat('{"role":"system","content":', to_json(system_text), '},') ELSE '' END"""
_SQL_PARTS = f"""concat('[', {_SQL_SYS}, '{{"role":"user","content":[{{"type":"text","text":', to_json(query), '}}',
    CASE WHEN image IS NOT NULL THEN concat(',{{"type":"image_url","image_url":{{"url":', to_json(concat('data:image/jpeg;base64,', image)), '}}}}') ELSE '' END,
    ']}}]')"""
_SQL_FLAT_TEXT = """to_json(concat(CASE WHEN system_text <> '' THEN concat('system_prompt:', chr(10), system_text) ELSE '' END,
    chr(10), 'query:', chr(10), query))"""
_SQL_FLAT = f"""concat('[', {_SQL_FLAT_TEXT}, CASE WHEN image IS NULL THEN '' ELSE concat(',', to_json(image)) END, ']')"""
_SQL_TWO = f"""concat('[', {_SQL_FLAT_TEXT}, CASE WHEN image IS NULL THEN '' ELSE concat(',', to_json(image), ',', to_json(image)) END, ']')"""
_SQL_MEDIA_PAYLOAD = f"""concat('[', {_SQL_SYS}, '{{"role":"user","content":[',
    CASE WHEN image IS NOT NULL THEN concat('{{"type":"image","source":{{"type":"base64",',
        CASE WHEN {_SQL_MEDIA} IS NOT NULL THEN concat('"media_type":', to_json({_SQL_MEDIA}), ',') ELSE '' END,
        '"data":', to_json(image), '}}}},') ELSE '' END,
    '{{"type":"text","text":', to_json(query), '}}]}}]')"""


@register("chat_payload", FX.with_fixtures(f"""
    SELECT item_id, {_SQL_PARTS} AS payload_parts, {_SQL_FLAT} AS payload_flat, {_SQL_TWO} AS payload_two,
           {_SQL_MEDIA_PAYLOAD} AS payload_media FROM d9""", d9=FX.D9))
def chat_payload(spark, sf_dir):
    """The three chat payload layouts as JSON text (absent system message dropped)."""
    d9 = D.d9_payloads(_t(spark, sf_dir))
    return d9.select("item_id",
                     PR.payload_parts("system_text", "query", "image").alias("payload_parts"),
                     PR.payload_flat("system_text", "query", "image").alias("payload_flat"),
                     PR.payload_flat("system_text", "query", F.array("image", "image"), many=True).alias("payload_two"),
                     PR.payload_media("system_text", "query", "image").alias("payload_media"))


@register("media_type", FX.with_fixtures(f"""
    SELECT item_id, {_SQL_MEDIA} AS media_type FROM d9""", d9=FX.D9))
def media_type(spark, sf_dir):
    """Image media type from its leading bytes."""
    d9 = D.d9_payloads(_t(spark, sf_dir))
    return d9.select("item_id", PR.media_type("image").alias("media_type"))


@register("base64_canonical", FX.with_fixtures("""
    SELECT item_id, to_base64(from_base64(image)) AS canonical FROM d9""", d9=FX.D9))
def base64_canonical(spark, sf_dir):
    """base64 text decoded and re-encoded without line breaks."""
    d9 = D.d9_payloads(_t(spark, sf_dir))
    return d9.select("item_id", PR.canonical_base64("image").alias("canonical"))


# ---------------------------------------------------------------------------
# Run metadata from result file names (D1 rows spread over files)

_MODE_ALT = "|".join(FI.MODE_NAMES)
_MODE_CASE_SQL = ("(CASE CAST(item_no % 6 AS INTEGER) "
                  + " ".join(f"WHEN {i} THEN {Q.q(m)}" for i, m in enumerate(FI.MODE_NAMES)) + " END)")


@register("run_metadata", FX.with_fixtures(f""",
    f AS (SELECT concat('m_', subcategory, '_', coalesce(subset, 'all'), '_',
                        {_MODE_CASE_SQL},
                        '_result.tsv') AS file_name FROM d1),
    p AS (SELECT file_name, count(*) AS n_rows,
                 regexp_extract(file_name, '_({_MODE_ALT})_result\\.tsv$', 1) AS mode,
                 regexp_replace(file_name, '_({_MODE_ALT})_result\\.tsv$', '') AS rest
          FROM f GROUP BY file_name)
    SELECT file_name, n_rows, mode, regexp_extract(rest, '^(.*)_[^_]*$', 1) AS model,
           regexp_extract(rest, '_([^_]*)$', 1) AS bench,
           regexp_extract(file_name, '^(.*)\\.[^.]*$', 1) AS run_stem,
           split_part(file_name, '.', 1) AS bench_stem
    FROM p""", d1=FX.D1))
def run_metadata(spark, sf_dir):
    """Per result file, its row count and the model, benchmark and mode in its name."""
    d1 = D.d1_yes_no(_t(spark, sf_dir))
    modes = F.element_at(F.array(*[F.lit(m) for m in FI.MODE_NAMES]), (F.col("item_no") % 6 + 1).cast("int"))
    named = d1.select(F.concat(F.lit("m_"), "subcategory", F.lit("_"), F.coalesce("subset", F.lit("all")),
                               F.lit("_"), modes, F.lit("_result.tsv")).alias("file_name"))
    per_file = named.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"))
    return FI.run_metadata(per_file, "file_name")


# ---------------------------------------------------------------------------
# Restartable incremental scoring and response collection (streaming)


def _table_stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; like the batch reader's, a table may be a file or a folder of files."""
    schema = _t(spark, sf_dir).table(name).schema
    return INC.read_stream(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", schema, "parquet")


@register("incremental_scoring", FX.with_fixtures(f""", {_D1_SIGN}
    SELECT item_no, run_id, verdict, sign FROM s""", d1=FX.D1))
def incremental_scoring(spark, sf_dir):
    """Documents as a file stream, scored and appended with a checkpoint.

    A second run over the same checkpoint adds no rows (tested); the
    returned frame reads the scored output back.
    """
    run = INC.new_run_folder(spark, "incremental-scoring")
    t = _t(spark, sf_dir)
    docs = _table_stream(spark, sf_dir, "documents")

    def score(stream):
        return (SU.HALLUCINATION.score_rows(D.d1_yes_no(t, documents=stream))
                .select("item_no", "run_id", "verdict", "sign"))

    INC.score_stream(docs, score, f"{run}/out", f"{run}/checkpoint")
    return spark.read.parquet(f"{run}/out")


@register("response_collection", FX.with_fixtures("""
    SELECT concat(CAST(i.item_id AS VARCHAR), '-', CAST(i.step AS VARCHAR)) AS request_id, i.prompt, c.text AS response
    FROM d7 i JOIN conversations c ON c.conv_id = i.item_id AND c.turn + 1 = i.step""", d7=FX.D7))
def response_collection(spark, sf_dir):
    """Response and request files streamed in and attached by key, every turn; the
    responses come first and wait in the stream's state for their requests."""
    run = INC.new_run_folder(spark, "response-collection")

    def request_id(item: str, step) -> "F.Column":
        return F.concat(F.col(item).cast("string"), F.lit("-"), step.cast("string")).alias("request_id")

    turns = _table_stream(spark, sf_dir, "conversations")
    responses = turns.select(request_id("conv_id", F.col("turn") + 1), F.col("text").alias("response"))
    made = D.d7_steps(_Turns(_table_stream(spark, sf_dir, "conversations")))
    requests = made.select(request_id("item_id", F.col("step")), "prompt")
    INC.collect_responses(responses, requests, f"{run}/responses", f"{run}/checkpoint")
    return spark.read.parquet(f"{run}/responses").select("request_id", "prompt", "response")


@dataclasses.dataclass
class _Turns:
    """The conversations as a stream, for the derivation of requests."""
    conversations: DataFrame


# ---------------------------------------------------------------------------
# Operators on harder rows: many options, null groups, the judge pass, real result files

_MANY_SQL = """m AS (SELECT list_sort(list_concat((SELECT array_agg(n_name) FROM nation),
                                                (SELECT array_agg(r_name) FROM region))) AS choices)"""
_MANY_DIST = "list_transform(m.choices, lambda c: levenshtein(answer_text, c))"


@register("options_many", FX.with_fixtures(f""", {_MANY_SQL},
    p AS (SELECT item_no, list_position({_MANY_DIST}, list_min({_MANY_DIST})) AS pos, len(m.choices) AS n_options
          FROM d3, m)
    SELECT item_no, n_options,
           CASE WHEN pos > 26 THEN concat('A', substr({_LETTERS}, pos - 26, 1)) ELSE substr({_LETTERS}, pos, 1) END AS nearest
    FROM p""", d3=FX.D3))
def options_many(spark, sf_dir):
    """S11 with 30 options: labels go on after Z (AA, AB, ...)."""
    t = _t(spark, sf_dir)
    names = t.nation.select(F.col("n_name").alias("name")).unionByName(t.region.select(F.col("r_name").alias("name")))
    choices = names.agg(F.sort_array(F.collect_list("name"))).scalar()       # one row: 30 names
    rows = D.d3_options(t).select("item_no", "answer_text", choices.alias("choices"))
    return rows.select("item_no", F.size("choices").cast("bigint").alias("n_options"),
                       AN.nearest_option("answer_text", "choices").alias("nearest"))


@register("numbering_null_groups", FX.with_fixtures("""
    SELECT item_no, subset, row_number() OVER (PARTITION BY subset ORDER BY item_no) - 1 AS position FROM d1""",
    d1=FX.D1))
def numbering_null_groups(spark, sf_dir):
    """Positions inside groups, rows without a group numbered as one group."""
    rows = D.d1_yes_no(_t(spark, sf_dir)).select("item_no", "subset")
    return W.dense_positions(rows, "item_no", ["subset"])


_JUDGE_INSTR = SU.LETTERED_CHOICE.instructions["choice"]


@register("judge_pipeline", FX.with_fixtures(f""",
    j AS (SELECT item_no, answer_letter, verdict, list_reduce(list_prepend('', list_transform(choices, lambda c, i:
                   concat(substr({_LETTERS}, i, 1), '. ', c, chr(10)))), lambda a, b: concat(a, b)) AS opts, answer_text
          FROM d3 WHERE item_no % 6 <> 0),
    v AS (SELECT *, CASE WHEN item_no % 11 = 0 THEN 'timeout' END AS error,
                 CASE WHEN item_no % 11 = 0 THEN NULL ELSE verdict END AS reply FROM j)
    SELECT item_no, 'choice' AS kind, {Q.q(_JUDGE_INSTR)} AS instruction,
           {Q.fill(PR.JUDGE_TEMPLATES['choice'], choices='opts', response='answer_text')} AS request,
           reply AS verdict, error,
           CASE WHEN reply IS NULL THEN 0
                ELSE CAST(contains(lower(reply), concat('(', lower(answer_letter), ')')) AS INTEGER) END AS sign
    FROM v""", d3=FX.D3))
def judge_pipeline(spark, sf_dir):
    """M11 + F1 + J3 + J6: the judge pass of a suite with choices, done rows and errors."""
    rows = D.d3_options(_t(spark, sf_dir))
    suite = dataclasses.replace(
        SU.LETTERED_CHOICE, answer=lambda df: F.concat(F.lit("("), F.lower("answer_letter"), F.lit(")")),
        choices=lambda df: AN.option_block("choices"), response=lambda df: F.col("answer_text"))
    failed = F.col("item_no") % 11 == 0
    replies = rows.select("item_no", F.when(~failed, F.col("verdict")).alias("response"),
                          F.when(failed, F.lit("timeout")).alias("error"))
    done = rows.where(F.col("item_no") % 6 == 0)
    return SU.judge(rows.drop("verdict"), suite, replies, done).select(
        "item_no", "kind", "instruction", "request", "verdict", "error", "sign")


@register("folder_scores", f"""
    SELECT concat('m', substr(run_id, 4)) AS model, {Q.q(FI.MODE_NAMES[0])} AS mode, metric_group, metric, value
    FROM ({_HALLU_LONG_SQL})""")
def folder_scores(spark, sf_dir):
    """R2 + R3 + R7 + W1 + A15: runs written as TSV folders with different column
    orders and response names, scanned by header and scored together."""
    folder = INC.new_run_folder(spark, "result-files")
    d1 = D.d1_yes_no(_t(spark, sf_dir)).select("item_no", "run_id", "subcategory", "gt_answer", "verdict")
    for k in range(4):
        name = f"m{k}_response"
        order = ["item_no", "subcategory", "gt_answer", name] if k % 2 else [name, "gt_answer", "item_no", "subcategory"]
        run = d1.where(F.col("run_id") == f"run{k}").withColumnRenamed("verdict", name)
        FI.append_rows(run.select(*order), f"{folder}/{FI.result_file_name(f'm{k}', 'd1.tsv', FI.MODE_NAMES[0])}", "tsv")
    rows = FI.scan_runs(spark, folder, ["item_no", "subcategory", "gt_answer"], "*.csv")
    # a run is a folder of part files here: its name is the file's parent
    rows = FI.run_metadata(rows.withColumn("file_name", F.element_at(F.split("file_path", "/"), -2)))
    rows = rows.withColumnRenamed("response", "verdict").withColumn("gt_answer", F.col("gt_answer").cast("int"))
    return SU.HALLUCINATION.report(rows, by=["model", "mode"])


# ---------------------------------------------------------------------------
# Remaining modes: M2 stepwise, M7/M8 chain requests, M8 visual chain with structured fallback

@register("mode_stepwise", FX.with_fixtures(f""", {_D7_BASE}
    SELECT i.item_id, concat({Q.q(PR.STEPWISE_PREFIX)}, i.prompt) AS prompt, r.response,
           CASE WHEN r.response IS NULL THEN 1 ELSE 0 END AS missing
    FROM items i LEFT JOIN lastr r ON i.item_id = r.item_id
    WHERE i.item_id NOT IN (SELECT item_id FROM items WHERE already_done = 1)""", d7=FX.D7))
def mode_stepwise(spark, sf_dir):
    """M2: the direct mode on step-by-step prefixed prompts."""
    d7 = _d7(spark, sf_dir)
    items = _items(d7)
    out = MO.stepwise(items, _last_responses(d7), done=items.filter(F.col("already_done") == 1))
    return out.select("item_id", "prompt", "response", "missing")


_SQL_CHAIN_SYS = "concat('{\"role\":\"system\",\"content\":', to_json(" + Q.q(CH.CHAIN_INSTRUCTION) + "), '},')"


@register("chain_requests", FX.with_fixtures(f"""
    SELECT item_id,
           concat('[', {_SQL_CHAIN_SYS}, '{{"role":"user","content":[{{"type":"text","text":', to_json(prompt), '}}]}}]') AS payload_text,
           concat('[', {_SQL_CHAIN_SYS}, '{{"role":"user","content":[{{"type":"text","text":', to_json(prompt), '}}',
                  CASE WHEN image IS NOT NULL THEN concat(',{{"type":"image_url","image_url":{{"url":', to_json(concat('data:image/jpeg;base64,', image)), '}}}}') ELSE '' END,
                  ']}}]') AS payload_visual
    FROM d7 WHERE step = 1""", d7=FX.D7))
def chain_requests(spark, sf_dir):
    """M7 / M8: chain-generation request payloads, without and with the image."""
    items = _items(_d7(spark, sf_dir))
    payload = lambda image: PR.payload_parts(F.lit(CH.CHAIN_INSTRUCTION), F.col("prompt"), image)
    return items.select("item_id", payload(F.lit(None).cast("string")).alias("payload_text"),
                        payload(F.col("image")).alias("payload_visual"))


@register("mode_visual", FX.with_fixtures(f""", {_D7_BASE},
    a1 AS (SELECT item_id, {Q.parse_steps(Q.refusal('generation', CH.REFUSAL_PHRASES, CH.FALLBACK_CHAIN))} AS rules
           FROM d6 WHERE attempt = 1),
    a2 AS (SELECT item_id, string_split(generation, chr(10)) AS st FROM d6 WHERE attempt = 2),
    vc AS (SELECT a1.item_id, coalesce(a1.rules, a2.st) AS chain FROM a1 LEFT JOIN a2 ON a1.item_id = a2.item_id),
    st AS (SELECT i.item_id, i.prompt, v.chain, s1.response AS intermediate_response,
                  {Q.last_instruction('v.chain', CH.LAST_STEP_PREFIX)} AS output_format
           FROM items i JOIN vc v ON i.item_id = v.item_id LEFT JOIN step1 s1 ON i.item_id = s1.item_id
           WHERE v.chain IS NOT NULL)
    SELECT st.item_id, CAST(len(st.chain) AS INTEGER) AS n_steps,
           {Q.fill(PR.FINAL_TEMPLATE, question='st.prompt', extracted_info='st.intermediate_response', output_format='st.output_format')} AS final_prompt,
           r.response
    FROM st LEFT JOIN lastr r ON st.item_id = r.item_id""", d7=FX.D7, d6=FX.D6))
def mode_visual(spark, sf_dir):
    """M8: a chain from the image (with the structured fallback), then the answer stages."""
    recorded = _one_pass(_d7(spark, sf_dir)).withColumnRenamed("step1", "intermediate_response").drop("chain")
    chains = _visual_chains(spark, sf_dir).where(F.col("chain").isNotNull())
    return MO.answer_recorded(recorded, chains).select("item_id", F.size("chain").alias("n_steps"), "final_prompt", "response")


def _visual_chains(spark, sf_dir) -> DataFrame:
    """Both recorded tries of an item in one aggregate: the first by the rules, the second as structured output."""
    d6 = D.d6_generations(_t(spark, sf_dir))
    tries = d6.where("attempt in (1, 2)").groupBy("item_id").agg(
        F.max(F.when(F.col("attempt") == 1, F.col("generation"))).alias("generation"),
        F.max(F.when(F.col("attempt") == 2, F.col("generation"))).alias("second"),
        F.bool_or(F.col("attempt") == 1).alias("tried")).where("tried")
    structured = CH.encode_structured(F.split("second", "\n", -1))
    rows = tries.select("item_id", CH.parse_steps(CH.refusal_fallback("generation")).alias("rules"),
                        CH.decode_structured(F.when(F.col("second").isNotNull(), structured)).alias("decoded"))
    return rows.select("item_id", F.coalesce("rules", "decoded").alias("chain"))


@register("visual_chain", FX.with_fixtures(f""",
    a1 AS (SELECT item_id, {Q.parse_steps(Q.refusal('generation', CH.REFUSAL_PHRASES, CH.FALLBACK_CHAIN))} AS rules
           FROM d6 WHERE attempt = 1),
    a2 AS (SELECT item_id, string_split(generation, chr(10)) AS st FROM d6 WHERE attempt = 2)
    SELECT a1.item_id, CAST(len(coalesce(a1.rules, a2.st)) AS INTEGER) AS n_steps,
           CASE WHEN a1.rules IS NOT NULL THEN 'rules' WHEN a2.st IS NOT NULL THEN 'structured' ELSE 'none' END AS chain_source
    FROM a1 LEFT JOIN a2 ON a1.item_id = a2.item_id""", d6=FX.D6))
def visual_chain(spark, sf_dir):
    """M8 + S26: one chain try from the image; on a failed parse use the structured response."""
    d6 = D.d6_generations(_t(spark, sf_dir))
    first = d6.filter(F.col("attempt") == 1).select("item_id", "generation")
    structured = d6.filter(F.col("attempt") == 2).select(
        "item_id", CH.encode_structured(F.split("generation", "\n", -1)).alias("structured"))
    out = MO.visual_chain(first, structured)
    return out.select("item_id", F.size("chain").alias("n_steps"), "chain_source")
