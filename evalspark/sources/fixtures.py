"""Derived benchmark-style tables D1-D9 built from the input tables.

The inputs carry no benchmark results, so every scored query starts from
one of these projections. Each one is a narrow select over a parquet scan
(plus at most one equi-join with a table Spark sizes itself), so the work
grows with the input tables. Text columns are carried whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.sources.tables import Tables


def _case(*pairs: tuple[Column, object], otherwise: object) -> Column:
    expr = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return expr.otherwise(other)


def d1_yes_no(t: Tables, documents: DataFrame | None = None) -> DataFrame:
    """One yes/no verdict per labelled document, four runs, null subsets.

    ``documents`` may be a stream of the documents table (I1); the labels
    side is then a static table joined to each micro-batch.
    """
    docs = documents if documents is not None else t.documents
    d = docs.select("doc_id", "lang", "source", "n_chars")
    lab = t.labels.select("doc_id", "quality")
    n = F.col("n_chars")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("item_no"),
        F.concat(F.lit("run"), (F.col("doc_id") % 4).cast("string")).alias("run_id"),
        F.col("lang").alias("subcategory"),
        F.when(n % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("source")).alias("subset"),
        F.col("quality").alias("gt_answer"),
        F.when(F.col("quality") == 1, F.lit(" Yes")).otherwise(F.lit("NO ")).alias("ground_truth"),
        _case((n % 11 == 0, "unclear"), (n % 5 == 0, "**No**, it is not."), (n % 7 == 0, "yes?"),
              otherwise="Yes.").alias("verdict"),
    )


def d2_pairs(t: Tables) -> DataFrame:
    """Two questions per picture: task, category, pair and group columns."""
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    lab = t.labels.select("doc_id", "quality", "toxic")
    k = F.col("k")
    nk = F.col("n_chars") + k
    truth = F.when(k == 0, F.col("quality")).otherwise(F.col("toxic"))
    return (d.join(lab, "doc_id")
            .withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
            .select(
                (2 * F.col("doc_id") + k).alias("item_no"),
                F.when(F.col("doc_id") % 23 != 0, F.col("doc_id")).alias("picture_name"),
                _case((F.col("doc_id") % 4 == 0, "existence"), (F.col("doc_id") % 4 == 1, "count"),
                      (F.col("doc_id") % 4 == 2, "OCR"), otherwise="code_reasoning").alias("subset"),
                F.col("lang").alias("category"),
                F.col("source").alias("subcategory"),
                F.when(truth == 1, F.lit("Yes")).otherwise(F.lit("No")).alias("ground_truth"),
                _case((nk % 9 == 0, "unclear"), (nk % 3 == 0, "No."), (k == 0, "yes"),
                      otherwise="no").alias("verdict"),
                F.when(k == 0, F.lit("(a)")).otherwise(F.lit("(b)")).alias("correct_answer"),
                _case((nk % 4 == 0, "unclear"), (k == 0, "The choice is (A)"),
                      otherwise="(b)").alias("choice_verdict"),
            ))


def d3_options(t: Tables) -> DataFrame:
    """Options per customer: the names of the nations in its region."""
    nation = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    options = (nation.groupBy("n_regionkey")
               .agg(F.array_sort(F.collect_list("n_name")).alias("choices")))
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    key = F.col("c_custkey")
    return (c.join(nation, c.c_nationkey == nation.n_nationkey)
            .join(options, "n_regionkey")
            .select(
                key.alias("item_no"),
                F.col("choices"),
                F.col("c_mktsegment").alias("question_type"),
                _case((key % 3 == 0, F.replace(F.col("n_name"), F.lit("_"), F.lit(" "))),
                      (key % 3 == 1, F.lower("n_name")),
                      otherwise=F.reverse(F.col("n_name"))).alias("answer_text"),
                F.when(key % 2 == 0, F.lit("A")).otherwise(F.lit("B")).alias("answer_letter"),
                _case((key % 5 == 0, "unclear"), (key % 5 == 1, "A"), (key % 5 == 2, "(B)"),
                      otherwise="I pick (A).").alias("verdict"),
            ))


#: The digits 0 to 9 of the Arabic script.
ARABIC_DIGITS = "".join(chr(0x660 + i) for i in range(10))


def d4_numeric(t: Tables) -> DataFrame:
    """Numeric, list, text and letter answers with near-miss verdicts; some numbers
    are longer than any number type, some verdicts repeat a number thousands of
    times or write it in other digits."""
    e = t.events.select("event_id", "user_id", "event_type", "value")
    et = F.col("event_type")
    eid = F.col("event_id")
    money = F.col("value").cast("decimal(10,2)").cast("string")
    uid = F.col("user_id").cast("string")
    answer = _case(
        (et == "click", F.lit("B")),
        (et == "view", money),
        (et == "error", F.concat(F.lit("["), uid, F.lit(", "), (eid % 7).cast("string"), F.lit("]"))),
        ((et == "signup") & (eid % 24 == 5), F.repeat(uid, 20)),
        (et == "signup", uid),
        otherwise="about ten")
    verdict = _case(
        (eid % 5 == 0, F.lit("unclear")),
        ((et == "signup") & (eid % 48 == 5), F.concat(F.lit(" +00"), F.repeat(uid, 20))),
        ((et == "signup") & (eid % 48 == 29), F.concat(F.repeat(uid, 20), F.lit("1"))),
        ((et == "signup") & (eid % 24 == 7), F.repeat(uid, 2000)),
        ((et == "signup") & (eid % 24 == 11), F.translate(uid, "0123456789", ARABIC_DIGITS)),
        (et == "click", F.when(eid % 2 == 0, F.lit("B.")).otherwise(F.lit("a"))),
        (et == "view", F.concat(money, _case((eid % 3 == 0, "0"), (eid % 3 == 1, ""), otherwise="d"))),
        (et == "error", F.concat(F.lit("["), uid, F.lit(","), (eid % 7).cast("string"),
                                 F.when(eid % 3 == 0, F.lit(".0]")).otherwise(F.lit("]")))),
        (et == "signup", F.concat(_case((eid % 4 == 0, "+"), (eid % 4 == 1, " "), otherwise=""), uid,
                                  F.when(eid % 3 == 0, F.lit(".0")).otherwise(F.lit("")))),
        otherwise="about ten")
    return e.select(
        eid.alias("item_no"),
        F.when(et == "click", F.lit("multi_choice")).otherwise(F.lit("free_form")).alias("question_type"),
        answer.alias("answer"),
        verdict.alias("verdict"),
    )


def d4_math(t: Tables) -> DataFrame:
    """D4 with options and metadata as stored literal text: choice rows have an answer
    that is close to one of their options (some a quoted one, some without options),
    every row has a skills list (some as a tuple)."""
    e = t.events.select("event_id", "user_id", "event_type", "value")
    et, eid = F.col("event_type"), F.col("event_id")
    uid, money = F.col("user_id").cast("string"), F.col("value").cast("decimal(10,2)").cast("string")
    text = F.concat
    plain = text(F.lit("['user "), uid, F.lit("', \"event "), (eid % 7).cast("string"), F.lit("\", 'value "),
                 F.coalesce(money, F.lit("none")), F.lit("']"))
    quoted = text(F.lit("['it\\'s "), uid, F.lit("', 'user "), uid, F.lit("']"))
    extra = e.select(
        eid.alias("item_no"),
        F.when(et == "click", _case((eid % 11 == 0, F.lit(None).cast("string")), (eid % 13 == 0, quoted),
                                    otherwise=plain)).alias("choices"),
        F.when(et == "click", _case((eid % 3 == 0, text(F.lit("User "), uid)), (eid % 3 == 1, "event"),
                                    otherwise=text(F.lit("value: "), F.coalesce(money, F.lit("none"))))).alias("option_answer"),
        F.when(et == "click", _case((eid % 5 == 0, "unclear"), (eid % 4 == 0, "A."), (eid % 4 == 1, "(b)"),
                                    (eid % 4 == 2, "c"), otherwise="B")).alias("option_verdict"),
        F.when(eid % 17 == 0, text(F.lit("{'skills': ('"), et, F.lit("',), 'grade': 1}"))).otherwise(
            text(F.lit("{'skills': ['"), et, F.lit("', 'parity "), (eid % 2).cast("string"), F.lit("'], 'grade': "),
                 (eid % 12).cast("string"), F.lit("}"))).alias("metadata"))
    return d4_numeric(t).join(extra, "item_no").select(
        "item_no", "question_type", "choices", "metadata",
        F.coalesce("option_answer", "answer").alias("answer"), F.coalesce("option_verdict", "verdict").alias("verdict"))


def d4_literals(t: Tables) -> DataFrame:
    """Verdicts and answers that are Python literals over the columns of a row, in
    eight spellings; every third verdict holds the next user's number."""
    e = t.events.select("event_id", "user_id", "event_type", "value")
    eid, et = F.col("event_id"), F.col("event_type")
    uid, money = F.col("user_id").cast("string"), F.col("value").cast("decimal(10,2)").cast("string")
    other = (F.col("user_id") + F.when(eid % 3 == 0, 1).otherwise(0)).cast("string")

    def text(*parts) -> Column:
        return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))

    spellings = [  # verdict, answer
        (text("(", other, ",", money, ")"), text("(", uid, ", ", money, ")")),
        (text("(", other, ", ", money, ")"), text("[", uid, ", ", money, "]")),
        (text("[\"", et, "\",", other, "]"), text("['", et, "', ", uid, "]")),
        (text("{'k': ", other, ".0}"), text("{'k': ", uid, "}")),
        (text("[", other, "]"), text("[", uid, ",]")),
        (et, text("'", et, "'")),
        (text("[", other, "], [", other, "]"), text("[", uid, "]")),
        (text("[", other, ", [", money, "0, '", et, "']]"), text("[", uid, ", [", money, ", '", et, "']]")),
    ]
    k = (eid % len(spellings)).cast("int") + 1
    return e.select(eid.alias("item_no"), F.element_at(F.array(*(v for v, _ in spellings)), k).alias("verdict"),
                    F.element_at(F.array(*(a for _, a in spellings)), k).alias("answer"))


def d5_skills(t: Tables) -> DataFrame:
    """Dict-literal metadata text with a skills list (quotes are single)."""
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    q = F.lit("'")
    second = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("source"))
    return d.select(
        F.col("doc_id").alias("item_no"),
        F.when(F.col("n_chars") % 3 == 0, F.lit(0)).otherwise(F.lit(1)).alias("sign"),
        F.concat(F.lit("{"), q, F.lit("skills"), q, F.lit(": ["), q, F.col("lang"), q, F.lit(", "), q,
                 second, q, F.lit("], "), q, F.lit("grade"), q, F.lit(": "),
                 (F.col("n_chars") % 12).cast("string"), F.lit("}")).alias("metadata"),
    )


def d6_generations(t: Tables) -> DataFrame:
    """Three chain generations per item, from whole document texts."""
    d = t.documents.select("doc_id", "text", "n_chars")
    did = F.col("doc_id")
    gen = _case(
        (F.col("n_chars") % 4 == 0, F.lit(" \n ")),
        (did % 17 == 0, F.lit("Sorry, I cannot answer that.")),
        (did % 2 == 0, F.concat(F.lit("Reasoning Steps:\nLook: first\n"), F.col("text"))),
        otherwise=F.col("text"))
    return d.select(
        ((did - did % 3) / 3).cast("bigint").alias("item_id"),
        (did % 3 + 1).alias("attempt"),
        gen.alias("generation"),
    )


def d7_steps(t: Tables) -> DataFrame:
    """Recorded step responses per item (one conversation per item)."""
    c = t.conversations.select("conv_id", "turn", "role", "text")
    cid = F.col("conv_id")
    return c.select(
        cid.alias("item_id"),
        (F.col("turn") + 1).alias("step"),
        F.col("role"),
        F.col("text").alias("response"),
        F.concat(F.lit("Question "), cid.cast("string"), F.lit(" {question}?")).alias("prompt"),
        F.lit("iVBORw0KGgo=").alias("image"),
        F.when(cid % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("already_done"),
    )


def d7_generations(t: Tables) -> DataFrame:
    """Three chain generations per conversation, one step for each of its turns; some
    do not parse, some refuse."""
    turns = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    cid, k = F.col("conv_id"), F.col("attempt")
    lines = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")),
                        lambda i: F.concat(F.lit("Look at turn "), i.cast("string"), F.lit(": who speaks")))
    return turns.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        cid.alias("item_id"), "attempt",
        _case((((k == 1) & (cid % 4 == 0)) | ((k == 2) & (cid % 8 == 0)) | (cid % 16 == 0), F.lit(" \n ")),
              ((k == 1) & (cid % 5 == 0), F.lit("I cannot answer this.")),
              otherwise=F.concat(F.lit("Reasoning steps:\n"), F.array_join(lines, "\n"))).alias("generation"))


def d8_judge(t: Tables) -> DataFrame:
    """Judge inputs: whole document texts as responses, repetitive rows."""
    d = t.documents.select("doc_id", "text", "lang", "source", "n_chars")
    did = F.col("doc_id")
    return d.select(
        did.alias("item_no"),
        F.col("lang").alias("answer"),
        F.concat(F.lit("A. "), F.coalesce("lang", F.lit("")), F.lit("\nB. "), F.coalesce("source", F.lit("")),
                 F.lit("\n")).alias("options"),
        _case((did % 4 == 0, "free_answer"), (did % 4 == 1, "yes_no"), (did % 4 == 2, "choice"),
              otherwise="number").alias("kind"),
        F.when(did % 10 == 0, F.repeat(F.lit("go "), 12)).otherwise(F.col("text")).alias("response"),
        _case((F.col("n_chars") % 4 == 0, "correct"), (F.col("n_chars") % 4 == 1, "incorrect"),
              (F.col("n_chars") % 4 == 2, "Correct"), otherwise="unclear").alias("verdict"),
    )


def d9_payloads(t: Tables) -> DataFrame:
    """Request rows with images of the four types (leading bytes, then the url's
    bytes), without an image, and with text, empty and null system texts."""
    p = t.pages.select("page_id", "url")
    pid = F.col("page_id")
    head = _case((pid % 5 == 0, "FFD8FFE000104A464946"), (pid % 5 == 1, "89504E470D0A1A0A"),
                 (pid % 5 == 2, "474946383961"), (pid % 5 == 3, "524946462400000057454250"),
                 otherwise=F.lit(None).cast("string"))
    image = F.regexp_replace(F.base64(F.concat(F.unhex(head), F.col("url").cast("binary"))), "[\\r\\n]", "")
    return p.select(
        pid.alias("item_id"),
        _case((pid % 3 == 0, "You are a careful judge."), (pid % 3 == 1, ""),
              otherwise=F.lit(None).cast("string")).alias("system_text"),
        F.col("url").alias("query"),
        image.alias("image"),
    )
