"""Chat formatting after collapsing cumulative snapshots (DataFrame functions only).

A log that stores a conversation after every turn holds it many times, each
time longer. Every turn gets a 128-bit hash of its place, role and text, and
the running xor of these hashes identifies each turn prefix. A conversation
is a snapshot if its whole hash is the hash of a shorter prefix of another
one; an anti-join against the proper prefixes drops snapshots, and of equal
conversations the smallest conv_id stays. Only the conversations that stay
are rendered.

Equal conversations are one row before any prefix is made, and prefixes are
distinct before the join, both pre-aggregated, so a first turn or a whole
conversation that a third of the log shares costs no single task more. A
conversation of over ``RANGE_TURNS`` turns is numbered and hashed in ranges of as many,
with running offsets. Its rendered text is one value, so that much stays bound to one row
of one task: a conversation of more than 2 GB cannot be rendered.

Defined results: turns are ordered by turn, role, text; a null role or text
counts as empty, a null turn comes first; rows equal in conv_id, turn, role
and text are one turn; a row with a null conv_id is a conversation of one turn by
itself, with a null id, which goes before any other among equals; other
columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.graph import written
from evalspark.operators.windows import dense_positions

#: Turns that are numbered and hashed together.
RANGE_TURNS = 50_000
#: Ids of longer conversations (8 bytes each) sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 100_000
#: The marks around a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def filled(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of the last two as empty."""
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))


def _hashes() -> tuple[Column, Column]:
    return (F.xxhash64(F.lit(1), "place", "role", "digest"), F.xxhash64("digest", "role", "place", F.lit(2)))


def _running(rows: DataFrame, keys: list[str]) -> DataFrame:
    """h1, h2 of every row: the xor of the hashes of its group up to its place."""
    upto = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g1, g2 = _hashes()
    return rows.withColumns({"h1": F.bit_xor(g1).over(upto), "h2": F.bit_xor(g2).over(upto)})


def _long_prefixes(rows: DataFrame) -> DataFrame:
    """Prefixes of conversations with very many turns: numbered and hashed in ranges
    of ``RANGE_TURNS`` turns, to which the xor of all ranges before is added."""
    numbered = dense_positions(rows.withColumn("at", F.struct("turn", "role", "digest")), "at", ["conv_id"], "place")
    ranged, _ = written(numbered.select("conv_id", (F.col("place") + 1).cast("int").alias("place"), "role", "digest").withColumn(
        "range", F.expr(f"(place - 1) div {RANGE_TURNS}")), "long-conversations")
    g1, g2 = _hashes()
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("conv_id", "range").agg(F.bit_xor(g1).alias("x1"), F.bit_xor(g2).alias("x2")).select(
        "conv_id", "range", *(F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(x) for x in ("x1", "x2")))
    return _running(ranged, ["conv_id", "range"]).join(offsets, ["conv_id", "range"]).select(
        "conv_id", "place", F.col("h1").bitwiseXOR(F.col("x1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("x2")).alias("h2"))


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ...), h1, h2: the hash of the turns up to each place, of
    every conversation with an id."""
    rows = filled(turns.where("conv_id is not null")).select(
        "conv_id", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest")).distinct()
    # those of over RANGE_TURNS turns: at most one in as many rows
    long, _ = written(turns.where("conv_id is not null").groupBy("conv_id").count().where(
        F.col("count") > RANGE_TURNS).select("conv_id"), "long-conversation-ids")
    n_long = long.count()
    if n_long:
        long = F.broadcast(long) if n_long <= BROADCAST_IDS else long
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "digest")
    short = rows.join(long, "conv_id", "left_anti") if n_long else rows
    out = _running(short.withColumn("place", F.row_number().over(order)), ["conv_id"]).select("conv_id", "place", "h1", "h2")
    return out.unionByName(_long_prefixes(rows.join(long, "conv_id", "left_semi"))) if n_long else out


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text of the conversations that no other one continues;
    ``text`` is that of a row without an id, null for the others."""
    prefixes = turn_prefixes(turns)
    whole = prefixes.groupBy("conv_id").agg(
        F.max(F.struct("place", "h1", "h2")).alias("end")).select("conv_id", "end.*")
    g1, g2 = _hashes()
    alone = filled(turns.where("conv_id is null")).withColumns({
        "place": F.lit(1), "digest": F.sha2(F.col("text").cast("binary"), 256)}).select(
        "conv_id", "place", g1.alias("h1"), g2.alias("h2"), rendered(F.col("role"), F.col("text")).alias("text"))
    # groups of equal conversations; a null id is the smallest
    distinct = whole.withColumn("text", F.lit(None).cast("string")).unionByName(alone).groupBy("place", "h1", "h2").agg(
        F.min(F.struct("conv_id")).alias("first"), F.max("text").alias("text"), F.count("*").alias("n_copies")).select(
        "first.conv_id", F.col("place").alias("n_turns"), "h1", "h2", "n_copies",
        F.when(F.col("first.conv_id").isNull(), F.col("text")).alias("text"))
    proper = prefixes.join(
        distinct.where("conv_id is not null").select("conv_id", "n_turns"), "conv_id").where("place < n_turns").select(
        F.col("place").alias("n_turns"), "h1", "h2").distinct()
    # a group named by a null id has one turn and continues nothing
    return distinct.join(proper, ["n_turns", "h1", "h2"], "left_anti").select(
        "conv_id", "n_turns", "n_copies", "text")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def chat_texts(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text: one rendered text per maximal conversation."""
    kept, _ = written(maximal(turns), "maximal")
    rows = filled(turns).join(kept.drop("text"), "conv_id")
    one = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id", "n_turns", "n_copies").agg(one.alias("turns")).select(
        "conv_id", "n_turns", "n_copies",
        F.array_join(F.transform("turns", lambda t: rendered(t["role"], t["text"])), "").alias("text")).unionByName(
        kept.where("conv_id is null"))


#: Prefixes as lists of (role, text), compared as they are, without hashes.
ORACLE = f"""
with t as (
  select distinct conv_id, case when conv_id is null then row_number() over () end as own,
         turn, coalesce(role, '') as role, coalesce("text", '') as body from conversations),
c as (
  select conv_id, count(*) as n,
         list({{'r': role, 'b': body}} order by turn nulls first, role, body) as turns
  from t group by conv_id, own),
d as (
  select case when bool_or(conv_id is null) then null else min(conv_id) end as conv_id,
         n, turns, count(*) as n_copies
  from c group by n, turns),
p as (
  select distinct list_slice(turns, 1, k) as turns
  from (select turns, unnest(range(1, n)) as k from d))
select conv_id, n as n_turns, n_copies,
       list_aggregate(list_transform(turns, lambda x: '{OPEN}' || x.r || chr(10) || x.b || '<|im_end|>' || chr(10)),
                      'string_agg', '') as "text"
from d where not exists (select 1 from p where p.turns = d.turns)
"""
