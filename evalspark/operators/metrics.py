"""Benchmark metrics as hash aggregates.

Every metric takes ``by`` (extra grouping keys, e.g. ``run_id``) so many
runs are scored in one job (A15). All aggregates are algebraic (sum,
count), so Spark runs a partial aggregate before the shuffle: a hot run,
task or skill holding a third of the rows costs one pre-aggregated row
per map task, never one giant group in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import col_, let, ternary_label

# Task names of the perception/cognition suite by category.
TASK_CATEGORIES = {
    "Perception": ["existence", "count", "position", "color", "posters", "celebrity",
                   "scene", "landmark", "artwork", "OCR"],
    "Cognition": ["commonsense_reasoning", "numerical_calculation", "text_translation",
                  "code_reasoning"],
}


def _ratio(num: Column, den: Column, zero: float | None = None) -> Column:
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return F.coalesce(r, F.lit(zero)) if zero is not None else r


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def _keys(by: Sequence[str]) -> list[str]:
    return list(by or ())


def accuracy(df: DataFrame, sign: str = "sign", by: Sequence[str] = ()) -> DataFrame:
    """A1 (+A15 with ``by``): correct = sum(sign), total = rows, accuracy."""
    return (df.groupBy(*_keys(by))
            .agg(F.coalesce(F.sum(sign), F.lit(0)).cast("bigint").alias("correct"),
                 F.count(F.lit(1)).alias("total"))
            .withColumn("accuracy", _ratio(F.col("correct"), F.col("total"))))


def accuracy_by(df: DataFrame, key: str, sign: str = "sign", by: Sequence[str] = ()) -> DataFrame:
    """A2: accuracy per category value; rows with a null category are left out."""
    return accuracy(df.filter(F.col(key).isNotNull()), sign, [*_keys(by), key])


def binary_prf(df: DataFrame, truth: str | Column, pred: str | Column,
               by: Sequence[str] = ()) -> DataFrame:
    """A3 + A4: confusion counts, precision/recall/F1 (0 on zero division), yes-rate."""
    t, p = col_(truth), col_(pred)
    out = (df.groupBy(*_keys(by))
           .agg(_count_if((t == 1) & (p == 1)).alias("tp"),
                _count_if((t != 1) & (p == 1)).alias("fp"),
                _count_if((t == 1) & (p != 1)).alias("fn"),
                _count_if((t != 1) & (p != 1)).alias("tn"),
                _count_if(p == 1).alias("predicted_yes"),
                F.count(F.lit(1)).alias("total")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({
        "precision": _ratio(tp, tp + fp, 0.0),
        "recall": _ratio(tp, tp + fn, 0.0),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn, 0.0),
        "yes_rate": _ratio(F.col("predicted_yes"), F.col("total"))})


def ternary_confusion(df: DataFrame, task: str, truth: str, pred: str,
                      by: Sequence[str] = ()) -> DataFrame:
    """A5: labels yes/no/unclear -> 1/0/-1 (prediction with '.' trimmed).

    ``acc`` compares labels over all rows; TP/FN/FP/TN and precision/recall
    use only rows whose prediction is not 'unclear'; ``other_num`` counts
    those. Unknown words give ``bad_label`` instead of an error.
    """
    g, p = ternary_label(truth), ternary_label(pred, strip_dots=True)
    clean = p.isNotNull() & (p != -1)
    out = (df.groupBy(*_keys(by), task)
           .agg(F.count(F.lit(1)).alias("n"),
                _count_if(g == p).alias("hits"),
                _count_if(clean & (g == 1) & (p == 1)).alias("TP"),
                _count_if(clean & (g == 1) & (p == 0)).alias("FN"),
                _count_if(clean & (g == 0) & (p == 1)).alias("FP"),
                _count_if(clean & (g == 0) & (p == 0)).alias("TN"),
                _count_if(p == -1).alias("other_num"),
                _count_if(g.isNull() | p.isNull()).alias("bad_label")))
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    return out.withColumns({
        "acc": _ratio(F.col("hits"), F.col("n")),
        "precision": _ratio(tp, tp + fp, 0.0),
        "recall": _ratio(tp, tp + fn, 0.0)}).drop("hits")


def plus_accuracy(df: DataFrame, task: str, group: str, sign: str = "sign",
                  by: Sequence[str] = (), denominator: str = "rows") -> DataFrame:
    """Groups (pictures) with exactly two correct rows, over all rows of the
    task (or its groups). Rows without a group count as rows, never as a group."""
    keys = [*_keys(by), task]
    per_group = (df.groupBy(*keys, group)
                 .agg(F.coalesce(F.sum(sign), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("r")))
    out = (per_group.groupBy(*keys)
           .agg(_count_if(F.col(group).isNotNull() & (F.col("s") == 2)).alias("plus_groups"),
                F.sum("r").cast("bigint").alias("n"),
                F.count(group).alias("groups")))
    den = F.col("n") if denominator == "rows" else F.col("groups")
    return out.withColumn("acc_plus", _ratio(F.col("plus_groups"), den))


def task_scores(df: DataFrame, task: str, group: str, truth: str, pred: str,
                sign: str = "sign", by: Sequence[str] = (),
                denominator: str = "rows") -> DataFrame:
    """A5-A7 in one scan: per-group partial sums, then per-task metrics and score.

    ``score = 100 * acc + 100 * acc_plus``.
    """
    keys = [*_keys(by), task]
    g, p = ternary_label(truth), ternary_label(pred, strip_dots=True)
    clean = p.isNotNull() & (p != -1)
    per_group = (df.groupBy(*keys, group)
                 .agg(F.count(F.lit(1)).alias("r"),
                      F.coalesce(F.sum(sign), F.lit(0)).alias("s"),
                      _count_if(g == p).alias("hits"),
                      _count_if(clean & (g == 1) & (p == 1)).alias("TP"),
                      _count_if(clean & (g == 1) & (p == 0)).alias("FN"),
                      _count_if(clean & (g == 0) & (p == 1)).alias("FP"),
                      _count_if(clean & (g == 0) & (p == 0)).alias("TN"),
                      _count_if(p == -1).alias("other_num")))
    summed = [F.sum(c).cast("bigint").alias(c) for c in ("hits", "TP", "FN", "FP", "TN", "other_num")]
    out = (per_group.groupBy(*keys)
           .agg(F.sum("r").cast("bigint").alias("n"),
                F.count(group).alias("groups"),
                _count_if(F.col(group).isNotNull() & (F.col("s") == 2)).alias("plus_groups"),
                *summed))
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    den = F.col("n") if denominator == "rows" else F.col("groups")
    acc, acc_plus = _ratio(F.col("hits"), F.col("n")), _ratio(F.col("plus_groups"), den)
    return out.withColumns({
        "acc": acc,
        "precision": _ratio(tp, tp + fp, 0.0),
        "recall": _ratio(tp, tp + fn, 0.0),
        "acc_plus": acc_plus,
        "score": acc * 100 + acc_plus * 100}).drop("hits")


def task_dimension(spark, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """The fixed task -> category table (14 rows; safe to broadcast)."""
    cats = categories or TASK_CATEGORIES
    rows = [(task, cat) for cat, tasks in cats.items() for task in tasks]
    return spark.createDataFrame(rows, "task string, eval_type string")


def with_task_category(df: DataFrame, task: str, dim: DataFrame) -> DataFrame:
    """Attach the category by an inner join with the broadcast task table."""
    d = dim.withColumnRenamed("task", task)
    return df.join(F.broadcast(d), task, "inner")


def category_rollup(scores: DataFrame, task: str, dim: DataFrame, score: str = "score",
                    by: Sequence[str] = ()) -> DataFrame:
    """Per-task rows and category totals at once via ``rollup``.

    The grand-total level is dropped; ``level`` is 'task' or 'category'.
    """
    keys = _keys(by)
    joined = with_task_category(scores.select(*keys, task, score), task, dim)
    rolled = (joined.rollup(*keys, "eval_type", task)
              .agg(F.sum(score).alias("score"), F.grouping_id().alias("_gid")))
    # only the two lowest levels are wanted: (.., eval_type, task) and (.., eval_type)
    rolled = rolled.filter(F.col("_gid") <= 1)
    return rolled.withColumn("level", F.when(F.col("_gid") == 0, F.lit("task"))
                             .otherwise(F.lit("category"))).drop("_gid")


def multilabel_accuracy(df: DataFrame, labels: str, sign: str = "sign",
                        by: Sequence[str] = (), label_name: str = "skill") -> DataFrame:
    """Each row counts once for each distinct label it carries."""
    exploded = _labels_of(df, F.array_distinct(labels), label_name, [*_keys(by), sign])
    return accuracy(exploded, sign, [*_keys(by), label_name])


def labelled_long(df: DataFrame, labels: str, sign: str = "sign", by: Sequence[str] = (),
                  group: str = "skill") -> DataFrame:
    """A1 + A9 + A13 in one scan: overall metrics and the accuracy of each label.

    A row is expanded into one for the overall level and one for each
    distinct label, which a partial aggregate takes in at once.
    """
    by = _keys(by)
    level = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.array_distinct(F.array_compact(labels)), F.array().cast("array<string>")))
    agg = accuracy(df.select(*by, sign, F.posexplode(level).alias("_p", "_label")).select(
        *by, sign, (F.col("_p") == 0).alias("_all"), "_label"), sign, [*by, "_all", "_label"])

    def row(name: str, metric: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("metric_group"), metric.alias("metric"), value.cast("double").alias("value"))

    top = F.array(*(row("overall", F.lit(m), F.col(m)) for m in ("correct", "total", "accuracy")))
    rows = F.when(F.col("_all"), top).otherwise(F.array(row(group, F.col("_label"), F.col("accuracy"))))
    return agg.select(*by, F.explode(rows).alias("m")).select(*by, "m.metric_group", "m.metric", "m.value")


def _labels_of(df: DataFrame, labels: Column, label_name: str, keep: Sequence[str]) -> DataFrame:
    """One row per label. An outer explode and a filter on its result: a plain
    explode has Catalyst infer a filter on the array, which would evaluate the
    expression that makes the array (a literal parse) a second time."""
    out = df.select(*keep, F.explode_outer(labels).alias(label_name))
    return out.where(F.col(label_name).isNotNull())


def distinct_labels(df: DataFrame, labels: str, label_name: str = "skill",
                    by: Sequence[str] = ()) -> DataFrame:
    """The distinct label set."""
    return _labels_of(df, F.col(labels), label_name, _keys(by)).distinct()


def pair_accuracy(df: DataFrame, position: str, sign: str = "sign",
                  by: Sequence[str] = ()) -> DataFrame:
    """Rows (0,1), (2,3), ... both correct; total = rows / 2 (float).

    ``position`` is the explicit 0-based order key; a lone tail row counts
    0 correct and 0.5 to the total.
    """
    keys = _keys(by)
    pairs = (df.groupBy(*keys, F.expr(f"`{position}` div 2L").alias("_pair"))
             .agg(F.count(F.lit(1)).alias("r"), _count_if(F.col(sign) == 1).alias("ones")))
    out = (pairs.groupBy(*keys)
           .agg(_count_if((F.col("r") == 2) & (F.col("ones") == 2)).alias("correct"),
                (F.sum("r") / F.lit(2.0)).alias("total")))
    return out.withColumn("accuracy", _ratio(F.col("correct"), F.col("total")))


def all_correct_groups(df: DataFrame, keys: Sequence[str], sign: str = "sign",
                       by: Sequence[str] = ()) -> DataFrame:
    """Share of groups whose rows are all correct (null keys dropped)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    grouped = (df.filter(cond).groupBy(*_keys(by), *keys)
               .agg(F.count(F.lit(1)).alias("r"), F.coalesce(F.sum(sign), F.lit(0)).alias("s")))
    return (grouped.groupBy(*_keys(by))
            .agg(_count_if(F.col("s") == F.col("r")).alias("correct_groups"),
                 F.count(F.lit(1)).alias("groups"))
            .withColumn("group_accuracy", _ratio(F.col("correct_groups"), F.col("groups"))))


def to_long(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str], group: str) -> DataFrame:
    """Wide metric row(s) -> (ids..., metric_group, metric, value double)."""
    cast = wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return (cast.unpivot(list(ids), list(metrics), "metric", "value")
            .withColumn("metric_group", F.lit(group))
            .select(*ids, "metric_group", "metric", "value"))


def category_long(per_cat: DataFrame, ids: Sequence[str], key: str, group: str = "category",
                  value: str = "accuracy") -> DataFrame:
    """Per-category accuracy rows in the long layout."""
    return per_cat.select(*ids, F.lit(group).alias("metric_group"),
                          F.col(key).cast("string").alias("metric"),
                          F.col(value).cast("double").alias("value"))


def wide_sheet(long: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per id with one column per metric (values listed: no extra job)."""
    return long.groupBy(*ids).pivot("metric", list(metrics)).agg(F.max("value"))


def max_word_count(text: str | Column, sep: str = " ") -> Column:
    """Largest count of one word among ``text.split(sep)`` (per row, no shuffle).

    Sorting the words puts equal ones next to each other; the indexes where
    a new word starts give every run length as the gap to the next start
    (or to the end). O(n log n) per row on the JVM, whole text, and no
    per-word object is built.
    """
    def longest(words: Column) -> Column:
        starts = F.filter(
            F.transform(words, lambda w, i: F.when((i == 0) | (w != F.get(words, i - 1)), i)),
            lambda i: i.isNotNull())
        return let(starts, lambda s: F.array_max(F.transform(
            s, lambda b, j: F.coalesce(F.get(s, j + 1), F.size(words)) - b)))

    return let(F.sort_array(F.split(col_(text), sep, -1)), longest)


def summary_long(df: DataFrame, by: Sequence[str] = (), sign: str = "sign", category: str | None = None,
                 truth: str | Column | None = None, pred: str | Column | None = None) -> DataFrame:
    """A1 + A2 + A3/A4 + A13 in one scan.

    Rows are aggregated by ``(by, category)``; the grouping sets ``(by)`` and
    ``(by, category)`` then run over those few rows, and each result row is
    exploded into the long layout ``(by..., metric_group, metric, value)``. Rows with a null
    category count in the overall level only.
    """
    by = _keys(by)
    aggs = [F.coalesce(F.sum(sign), F.lit(0)).cast("bigint").alias("correct"),
            F.count(F.lit(1)).alias("total")]
    if truth is not None:
        t, p = col_(truth), col_(pred)
        aggs += [_count_if((t == 1) & (p == 1)).alias("tp"), _count_if((t != 1) & (p == 1)).alias("fp"),
                 _count_if((t == 1) & (p != 1)).alias("fn"), _count_if(p == 1).alias("predicted_yes")]
    if category:
        # Rows are aggregated once, by category; the overall level is summed
        # from those few rows, so no input row is expanded.
        sums = ["correct", "total", *(["tp", "fp", "fn", "predicted_yes"] if truth is not None else [])]
        fine = df.groupBy(*by, category).agg(*aggs)
        agg = fine.groupingSets([by, [*by, category]], *by, category).agg(
            *(F.sum(c).alias(c) for c in sums), F.grouping(category).alias("_top"))
    else:
        agg = df.groupBy(*by).agg(*aggs, F.lit(1).alias("_top"))

    def row(group: str, metric: Column, value: Column) -> Column:
        return F.struct(F.lit(group).alias("metric_group"), metric.cast("string").alias("metric"),
                        value.cast("double").alias("value"))

    correct, total = F.col("correct"), F.col("total")
    acc = _ratio(correct, total)
    top = [row("overall", F.lit("correct"), correct), row("overall", F.lit("total"), total),
           row("overall", F.lit("accuracy"), acc)]
    if truth is not None:
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        top += [row("binary", F.lit("precision"), _ratio(tp, tp + fp, 0.0)),
                row("binary", F.lit("recall"), _ratio(tp, tp + fn, 0.0)),
                row("binary", F.lit("f1"), _ratio(2 * tp, 2 * tp + fp + fn, 0.0)),
                row("binary", F.lit("yes_rate"), _ratio(F.col("predicted_yes"), total))]
    rows = F.array(*top)
    keep = F.col("_top") == 1
    if category:
        rows = F.when(keep, rows).otherwise(F.array(row("category", F.col(category), acc)))
        keep = keep | F.col(category).isNotNull()
    return (agg.filter(keep).select(*by, F.explode(rows).alias("m"))
               .select(*by, "m.metric_group", "m.metric", "m.value"))
