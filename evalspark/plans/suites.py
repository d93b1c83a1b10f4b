"""Scoring suites (M12-M17) and the user extension surface (F1).

A ``Suite`` is data, not a class hierarchy: a column expression for the
answer, a sign rule, and a metric builder. Users override any of them by
passing their own callables (``dataclasses.replace(suite, answer=...)``).
Everything is a Catalyst expression except the Python-literal fallback of
the numeric rule (an Arrow-batched pandas UDF that only works on rows the
JVM rule cannot decide).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions import answers as A
from evalspark.functions import literals as L
from evalspark.functions import prompts as P
from evalspark.functions import signs as S
from evalspark.functions import text as X
from evalspark.operators import joins as J
from evalspark.operators import metrics as M
from evalspark.plans.answers import AnswerTable, Call

AnswerFn = Callable[[DataFrame], Column]
SignFn = Callable[[DataFrame, str, str], DataFrame]
MetricFn = Callable[[DataFrame, Sequence[str]], DataFrame]


def _column_sign(rule: Callable[[Column, Column], Column]) -> SignFn:
    def apply(df: DataFrame, verdict: str, answer: str) -> DataFrame:
        return df.withColumn("sign", rule(F.col(verdict), F.col(answer)))
    return apply


@dataclass(frozen=True)
class Suite:
    name: str
    answer: AnswerFn                      # find_answer: the expected answer per row
    sign: SignFn                          # extract rule: verdict vs answer -> sign
    metrics: MetricFn                     # score: scored table -> long metrics
    kind: str = "yes_no"                  # judge request kind (S21)
    choices: AnswerFn | None = None       # find_choice: option text for the judge
    required: tuple[str, ...] = field(default_factory=tuple)
    response: AnswerFn | None = None      # find_response: the text to judge
    instructions: dict[str, str] | None = None   # judge instructions by kind, over the default ones
    prepare: Callable[[DataFrame], DataFrame] | None = None   # parses stored columns once, before anything reads them
    rule: Callable[[Column, Column], Column] = S.token_sign   # yes/no and choice rows of other kinds than the suite's

    def prepared(self, df: DataFrame) -> DataFrame:
        return self.prepare(df) if self.prepare else df

    def own_kinds(self) -> tuple[str, ...]:
        return ("choice", "number") if self.kind == "mixed" else (self.kind,)

    def sign_by_kind(self, df: DataFrame, verdict: str, answer: str, kind: str) -> DataFrame:
        """Sign of rows that say their kind: the suite's rule for its own kinds, the
        kind's rule for the others (S2/S3, S4, S5); an unknown kind has no sign."""
        k, v, a = F.col(kind), F.col(verdict), F.col(answer)
        own = k.isin(*self.own_kinds())
        out = self.sign(df, verdict, answer).withColumnRenamed("sign", "_own")
        out = L.score_numeric(out, verdict, answer, "_number", only=~own & (k == "number"))
        return out.withColumn("sign", F.when(own, F.col("_own")).when(k.isin("yes_no", "choice"), self.rule(v, a))
                              .when(k == "number", F.col("_number"))
                              .when(k == "free_answer", S.exact_sign(v))).drop("_own", "_number")

    def judge_kind(self, df: DataFrame) -> Column:
        """Judge request kind per row: a ``kind`` column wins over the suite's;
        the mixed kind asks for an option or a number, as the question does."""
        if "kind" in df.columns:
            return F.col("kind")
        if self.kind == "mixed":
            return F.when(F.col("question_type") == "multi_choice", F.lit("choice")).otherwise(F.lit("number"))
        return F.lit(self.kind)

    def score_rows(self, df: DataFrame, verdict: str = "verdict") -> DataFrame:
        """Per row: ``answer`` and ``sign`` columns added."""
        missing = [c for c in self.required if c not in df.columns]
        if missing:
            raise ValueError(f"suite {self.name} needs columns {missing}")
        df = self.prepared(df)
        with_answer = df.withColumn("answer", self.answer(df))
        return self.sign(with_answer, verdict, "answer")

    def report(self, df: DataFrame, verdict: str = "verdict", by: Sequence[str] = ()) -> DataFrame:
        """Scored rows -> long metrics ``(by..., metric_group, metric, value)``."""
        return self.metrics(self.score_rows(df, verdict), list(by))


# ---- metric builders -------------------------------------------------------

def overall_long(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return M.to_long(M.accuracy(df, "sign", by), by, ["correct", "total", "accuracy"], "overall")


def category_accuracy_long(key: str) -> MetricFn:
    def build(df: DataFrame, by: Sequence[str]) -> DataFrame:
        return M.category_long(M.accuracy_by(df, key, "sign", by), by, key)
    return build


def prf_long(truth: Callable[[], Column], pred: Callable[[], Column]) -> MetricFn:
    def build(df: DataFrame, by: Sequence[str]) -> DataFrame:
        wide = M.binary_prf(df, truth(), pred(), by)
        return M.to_long(wide, by, ["precision", "recall", "f1", "yes_rate"], "binary")
    return build


@dataclass(frozen=True)
class Summary:
    """Overall, per-category and binary metrics from one grouping-sets aggregate."""
    category: str | None = None
    truth: Callable[[], Column] | None = None
    pred: Callable[[], Column] | None = None

    def __call__(self, df: DataFrame, by: Sequence[str]) -> DataFrame:
        return M.summary_long(df, by, "sign", self.category,
                              self.truth() if self.truth else None, self.pred() if self.pred else None)


def summary(category: str | None = None, truth: Callable[[], Column] | None = None,
            pred: Callable[[], Column] | None = None) -> MetricFn:
    return Summary(category, truth, pred)


def combine(*builders: MetricFn) -> MetricFn:
    def build(df: DataFrame, by: Sequence[str]) -> DataFrame:
        parts = [p for p in (b(df, by) for b in builders) if p is not None]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    return build


def perception_long(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """M13 metrics: per-task scores and category totals, long layout."""
    scores = M.task_scores(df, "subset", "picture_name", "ground_truth", "verdict", "sign", by)
    dim = M.task_dimension(df.sparkSession)
    rolled = M.category_rollup(scores, "subset", dim, "score", by)
    return rolled.select(
        *by,
        F.when(F.col("level") == "category", F.lit("category_total")).otherwise(F.lit("task_score"))
        .alias("metric_group"),
        F.when(F.col("level") == "category", F.concat(F.col("eval_type"), F.lit("_total")))
        .otherwise(F.col("subset")).alias("metric"),
        F.col("score").cast("double").alias("value"))


def pair_long(df: DataFrame, by: Sequence[str]) -> DataFrame:
    wide = M.pair_accuracy(df, "item_no", "sign", by)
    return M.to_long(wide, by, ["correct", "total", "accuracy"], "pairs")


def skill_long(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """M16 metrics: overall, and per skill if the rows have metadata, in one aggregate."""
    if "metadata" not in df.columns:
        return overall_long(df, by)      # no skills to report
    parsed = L.parse_skills(df.select(*by, "sign", "metadata"), "metadata", "skills")
    return M.labelled_long(parsed, "skills", "sign", by, "skill")


# ---- the six suites ----------------------------------------------------------

HALLUCINATION = Suite(
    name="hallucination",
    answer=lambda df: X.yes_no_answer("gt_answer"),
    sign=_column_sign(S.token_sign),
    metrics=summary("subcategory", lambda: F.col("gt_answer"), lambda: X.says_yes("verdict")),
    required=("gt_answer",),
)

OBJECT_PROBE = Suite(
    name="object_probe",
    answer=lambda df: X.lower_strip("ground_truth"),
    sign=_column_sign(S.token_sign),
    metrics=summary("subset", lambda: X.says_yes("ground_truth"), lambda: X.says_yes("verdict")),
    required=("ground_truth",),
)

PERCEPTION = Suite(
    name="perception",
    answer=lambda df: F.col("ground_truth"),
    sign=_column_sign(S.token_sign),
    metrics=perception_long,
    required=("ground_truth", "subset", "picture_name"),
)

LETTERED_CHOICE = Suite(
    name="lettered_choice",
    answer=lambda df: X.paren_letter("answer_letter"),
    sign=_column_sign(S.contains_sign),
    rule=S.contains_sign,
    metrics=summary("question_type"),
    kind="choice",
    choices=lambda df: F.col("choices_text"),
    instructions={"choice": ("Reply with the letter, upper case and in round brackets, of the option that the "
                             "response picks, or with 'unclear' if it picks none.")},
    required=("answer_letter",),
)


def _math_answer(df: DataFrame) -> Column:
    """Option label for choice questions; a row without choices keeps its answer
    and is marked ``no_choices`` by the sign rule."""
    choices = _choice_list(df)
    return (F.when((F.col("question_type") == "multi_choice") & (F.size(choices) > 0),
                   A.nearest_option("answer", choices))
            .otherwise(F.col("answer")))


def _math_prepare(df: DataFrame) -> DataFrame:
    """List-literal choices as an array, parsed once for answers, requests and signs."""
    df = df.withColumn("_stored_answer", F.col("answer"))
    if "choices" in df.columns and isinstance(df.schema["choices"].dataType, T.StringType):
        return L.parse_string_list(df, "choices", "choices")
    return df


def _choice_list(df: DataFrame) -> Column:
    return F.col("choices") if "choices" in df.columns else F.lit(None).cast("array<string>")


def _math_sign(df: DataFrame, verdict: str, answer: str) -> DataFrame:
    choice = F.col("question_type") == "multi_choice"
    # rows that are no choice have the answer as it was stored, a plain column
    stored = "_stored_answer" if "_stored_answer" in df.columns else answer
    num = L.score_numeric(df, verdict, stored, "_num", only=~F.coalesce(choice, F.lit(False)))
    return (num.withColumn("sign", F.when(choice, S.token_sign(verdict, answer)).otherwise(F.col("_num")))
               .withColumn("no_choices", (choice & ~F.coalesce(F.size(_choice_list(df)) > 0, F.lit(False))).cast("int"))
               .drop("_num", "_stored_answer"))


MATH_MIXED = Suite(
    name="math_mixed",
    answer=_math_answer,
    sign=_math_sign,
    metrics=skill_long,
    kind="mixed",
    prepare=_math_prepare,
    choices=lambda df: A.option_block(_choice_list(df)),
    required=("question_type", "answer"),
)

PAIRED_CHOICE = Suite(
    name="paired_choice",
    answer=lambda df: F.col("correct_answer"),
    sign=_column_sign(S.contains_sign),
    rule=S.contains_sign,
    metrics=pair_long,
    kind="choice",
    instructions={"choice": ("Reply with the letter, lower case and in round brackets, of the option that the "
                             "response picks, or with 'unclear' if it picks none.")},
    required=("correct_answer", "item_no"),
)

#: Any rows that say their kind: a yes/no, choice, number or free answer each.
BY_KIND = Suite(
    name="by_kind",
    answer=lambda df: F.col("answer"),
    sign=_column_sign(S.token_sign),
    metrics=summary("kind"),
    required=("kind", "answer"),
)


def judge(items: DataFrame, suite: Suite, verdicts: DataFrame | str | Call | Callable[[DataFrame], DataFrame],
          done: DataFrame | None = None, key: str = "item_no", order: str | None = None,
          answers: AnswerTable | None = None) -> DataFrame:
    """The judge pass over a suite's result rows.

    Rows already judged (J3) are left out; a request is composed by kind from
    the suite's response, answer, choices and instructions (S21); repetitive
    free answers get 'unclear' without a call (S22); the other verdicts come
    from ``verdicts``: a table (``key``, ``response``, optionally ``error``), the
    name of a column of the items, or a model. A model (a ``Call`` or a
    responder) is asked at once and through ``answers`` (a new table if none is
    given), so every request is asked once whatever is done with the result.
    The sign goes by the kind of a row where the items have a ``kind`` column,
    else by the suite. Errors are kept; an errored, unanswered or unknown row has sign 0.

    Returns the items' columns with kind, instruction, request, answer,
    verdict, error, guarded and sign.
    """
    todo = suite.prepared(J.pending(items, done, key) if done is not None else items)
    text = suite.response(todo) if suite.response else F.col("response")
    rows = todo.withColumns({"_kind": suite.judge_kind(todo), "_text": text,
                             "_choices": suite.choices(todo) if suite.choices else F.lit("")})
    rows = X.bind(rows, _answer=suite.answer(todo))
    composed = P.fill(P.JUDGE_TEMPLATES["free_answer"], answer="_answer", response="_text")
    guard = F.when(F.col("_kind") == "free_answer", P.repetition_guard(composed)).otherwise(F.lit(False))
    rows = rows.withColumns({
        "instruction": P.judge_instruction("_kind", {**P.JUDGE_INSTRUCTIONS, **(suite.instructions or {})}),
        "request": P.judge_text("_kind", "_text", F.col("_answer"), F.col("_choices"))})
    free = "kind" in items.columns or "free_answer" in suite.own_kinds()
    rows = X.bind(rows, guarded=guard) if free else rows.withColumn("guarded", F.lit(False))
    if isinstance(verdicts, str):
        got = rows.withColumn("verdict", F.col(verdicts))
        got = got if "error" in rows.columns else got.withColumn("error", F.lit(None).cast("string"))
    else:
        if isinstance(verdicts, Call) or callable(verdicts):
            table = answers or AnswerTable(items.sparkSession)
            asked = rows.where(~F.col("guarded") & F.col("request").isNotNull()).select(
                F.col(key).alias(table.key), F.concat_ws("\n", "instruction", "request").alias("query"))
            verdicts = table.ask(asked, getattr(verdicts, "model", verdicts)).withColumnRenamed(table.key, key)
        if "error" not in verdicts.columns:
            verdicts = verdicts.withColumn("error", F.lit(None).cast("string"))
        got = J.attach_responses(rows.drop("verdict", "error"), verdicts, key, out="verdict", order=order).drop("missing")
    known = F.coalesce(F.col("_kind").isin(*P.JUDGE_TEMPLATES), F.lit(False))
    got = got.withColumns({"verdict": F.when(F.col("guarded"), F.lit("unclear")).otherwise(F.col("verdict")),
                           "error": F.when(~known, F.lit("unknown kind")).when(~F.col("guarded"), F.col("error")),
                           "answer": F.col("_answer")})
    failed = ~known | (~F.col("guarded") & (F.col("error").isNotNull() | F.col("verdict").isNull()))
    got = got.drop("sign")
    signed = (suite.sign_by_kind(got, "verdict", "answer", "_kind") if "kind" in items.columns
              else suite.sign(got, "verdict", "answer"))
    return (signed.withColumn("sign", F.when(failed, F.lit(0)).otherwise(F.coalesce("sign", F.lit(0))))
                  .withColumn("kind", F.col("_kind")).drop("_kind", "_text", "_answer", "_choices"))


def judge_counts(judged: DataFrame, by: Sequence[str] = ("kind",)) -> DataFrame:
    """Rows, correct rows, guarded rows and errors of a judge pass."""
    return judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("sign"), F.lit(0)).cast("bigint").alias("correct"),
        F.count_if(F.col("guarded")).alias("n_guarded"), F.count("error").alias("n_errors"))


SUITES = {s.name: s for s in (HALLUCINATION, PERCEPTION, OBJECT_PROBE, LETTERED_CHOICE,
                               MATH_MIXED, PAIRED_CHOICE)}


def multi_report(suites: Sequence[Suite], df: DataFrame, verdict: str = "verdict",
                 by: Sequence[str] = ()) -> DataFrame:
    """Several suites over the same rows in one job, ``suite`` as the first key.

    Suites whose metrics are a category + binary summary are scored in
    place on each row, stacked with ``inline`` (one struct per suite) and
    aggregated by one grouping-sets aggregate: one scan and one shuffle for
    all of them. Any other suite runs its own report and is unioned.
    """
    by = list(by)
    shared = [s for s in suites if isinstance(s.metrics, Summary)
              and s.metrics.category and s.metrics.truth and s.metrics.pred]
    parts = []
    if shared:
        scored = df.withColumn("_answer", F.col("answer")) if "answer" in df.columns else df
        entries = []
        for i, suite in enumerate(shared):
            spec = suite.metrics
            scored = suite.score_rows(scored, verdict).withColumnRenamed("sign", f"_sign{i}")
            # the next suite's rule reads the table's own answer, if there is one
            scored = scored.drop("answer") if "answer" not in df.columns else scored.withColumn("answer", F.col("_answer"))
            entries.append(F.struct(
                F.lit(suite.name).alias("suite"),
                F.col(spec.category).cast("string").alias("category"),
                F.col(f"_sign{i}").cast("int").alias("sign"),
                spec.truth().cast("int").alias("truth"),
                spec.pred().cast("int").alias("pred")))
        stacked = scored.select(*by, F.inline(F.array(*entries)))
        parts.append(M.summary_long(stacked, ["suite", *by], "sign", "category", "truth", "pred"))
    for suite in suites:
        if suite not in shared:
            parts.append(suite.report(df, verdict, by).select(F.lit(suite.name).alias("suite"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
