"""Benchmark decontamination by SimHash windows (DataFrame functions only).

Words are lower-cased runs of letters and digits; a shingle is five words.
A document matches an item if one of its windows, as many words long as the
item, has a weighted-shingle similarity of at least ``threshold`` to it: the
sum of the smaller counts of each shingle over the sum of the larger ones.
Words and shingles are compared by 64-bit hashes.

1. A window that similar shares shingles with the item, wherever they lie in
   it: of n and m shingles at least threshold * (n + m) / (1 + threshold).
   One scan finds the places of each text that hold a shingle of an item of a
   size, and every window of that size with that many such places is taken, at
   whatever offset. No other window can reach the threshold, so this leaves
   none out. Only places (integers) are gathered, in ranges of ``RANGE`` words that
   overlap by an item, so a text of any length makes rows of a bounded size.
2. The texts with such windows, each distinct one once, are cut into the same
   ranges of shingle hashes. Equal windows are one row from here on, whatever number
   of places and documents holds them.
3. Windows and items get 64-bit SimHash fingerprints: bits are counted 64 at a
   time in vertical counters. Fingerprints are cut into ``radius + 1`` blocks, and a
   window meets an item of its size in an index of (size, block, value): any two
   within the radius agree on a block, so all of them are found. The index holds
   ids and fingerprints; pairs within the radius are made distinct before shingles
   join them. A similarity of 0.8 means an angle whose mean distance is 9.7 bits with
   a standard deviation of 2.9, whatever the item's size; 23 is four and a half of these above.
4. The exact similarity of these pairs is computed from the shingles.

Defined results: null and empty texts have no shingle and match nothing, as
have items of fewer than five words; a document shorter than the item is one
window; ``matches`` names no rows with a null doc_id (``clean`` judges them like any
other) and leaves out items with a null id; repeated ids count as one; of several windows the
best similarity is given; other columns are not carried by ``matches``. A text longer
than ``PIECE_CHARS`` is split into words piece by piece, cut between words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.graph import drop_written, written

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
#: Words of a range of a text, and characters of a piece that is split into words at once.
RANGE = 1 << 14
PIECE_CHARS = 1 << 19
#: Item shingles (16 bytes each) and text keys (16 bytes each) sent to every task; more
#: are joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000
BROADCAST_KEYS = 1_000_000
KEY = ["k1", "k2"]
_SEPARATOR = r"[^\\p{L}\\p{N}]"


def text_key(text: str = "text") -> list[Column]:
    """A text's identity: two 64-bit hashes."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), F.col(text)).alias("k2")]


def word_hashes(text: str) -> Column:
    """Hashes of a text's words, in order. A long text is cut at the first separator
    after every ``PIECE_CHARS`` characters, and only hashes of its words are held together."""
    def of_piece(piece: str) -> str:
        return f"transform(array_remove(split({piece}, '{_SEPARATOR}+'), ''), w -> xxhash64(w))"

    p = PIECE_CHARS
    cut = (f"filter(transform(sequence(1, length(low) div {p}), i -> struct(i * {p} as base, "
           f"regexp_instr(substring(low, i * {p} + 1, {p}), '{_SEPARATOR}') as place)), c -> c.place > 0)")
    cuts = f"concat(array(0), transform({cut}, c -> cast(c.base + c.place as int)), array(length(low) + 1))"
    pieces = (f"transform(array({cuts}), at -> flatten(transform(sequence(0, size(at) - 2), "
              f"j -> {of_piece('substring(low, at[j] + 1, at[j + 1] - at[j] - 1)')})))[0]")
    return F.expr(f"transform(array(lower({text})), low -> if(length(low) <= {p}, {of_piece('low')}, {pieces}))[0]")


def shingle_hash(words: Column, at: Column) -> Column:
    """Hash of the shingle that begins at a place of a word-hash array."""
    return F.xxhash64(*(F.get(words, at + k) for k in range(SHINGLE)))


def shingle_hashes(words: str) -> Column:
    """All shingle hashes of a word-hash array of at least a shingle."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: shingle_hash(F.col(words), i))


def fingerprint(parts: str, most: int) -> Column:
    """SimHash of an array of at most ``most`` hashes: the bits set in over half of them.

    Field p_j of the state holds bit j of the 64 counts side by side. Adding a hash
    carries into p_j where it and all lower fields are set; the counts are then
    compared with half the number of hashes, again for all 64 at once.
    """
    bits = range(max(1, most.bit_length()))
    zero = "named_struct(" + ", ".join(f"'p{j}', 0L" for j in bits) + ")"
    add = "named_struct(" + ", ".join(
        f"'p{j}', acc.p{j} ^ (" + " & ".join(["h", *(f"acc.p{i}" for i in range(j))]) + ")" for j in bits) + ")"
    half = {j: f"(if(((size({parts}) div 2) >> {j}) & 1 = 1, -1L, 0L))" for j in bits}
    same = {j: f"~(acc.p{j} ^ {half[j]})" for j in bits}
    above = " | ".join("(" + " & ".join([f"acc.p{j}", f"~{half[j]}", *(same[i] for i in bits if i > j)]) + ")" for j in bits)
    return F.expr(f"aggregate({parts}, {zero}, (acc, h) -> {add}, acc -> {above})")


def blocks(fp: Column, radius: int) -> Column:
    """Pairs (block, value) of a fingerprint cut into radius + 1 blocks."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(F.struct(
        F.lit(i).alias("block"),
        F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))))


def shared_count(a: str, b: str) -> Column:
    """Sum of the smaller counts of two arrays; where neither has repeats, their common elements."""
    return F.expr(f"""
      if(size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b}),
         size(array_intersect({a}, {b})),
         aggregate(array_intersect({a}, {b}), 0, (n, s) -> n + least(
           size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s)))))""")


def least_hits(n: Column, size: Column, threshold: float) -> Column:
    """Places that a window of ``size`` words in a text of ``n`` must share with an item of its size."""
    most = F.least(n, size) + size - 2 * (SHINGLE - 1)
    return F.greatest(F.lit(1), F.ceil(most * (threshold / (1 + threshold)) - 1e-9).cast("int"))


def spans(texts: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    """k1, k2, size, block, spans (first, last): where windows of ``size`` words with enough
    shared places begin. A window belongs to the range of its first such place."""
    places = texts.select(*KEY, word_hashes("text").alias("words")).where(F.size("words") >= SHINGLE).select(
        *KEY, "words", F.explode(F.sequence(F.lit(0), F.size("words") - SHINGLE)).alias("at"))
    hits = places.select(*KEY, F.size("words").alias("n"), "at", shingle_hash(F.col("words"), F.col("at")).alias("hash")).join(
        seeds, "hash").select(*KEY, "n", "size", "at")
    # a range also holds the places of the next one that its own windows reach
    block = F.expr(f"at div {RANGE}").cast("int")
    ranged = hits.withColumn("block", F.explode(F.when(
        (F.col("at") >= RANGE) & (F.col("at") % RANGE < F.col("size")), F.array(block, block - 1)).otherwise(F.array(block))))
    held = ranged.groupBy(*KEY, "n", "size", "block").agg(F.sort_array(F.collect_set("at")).alias("hits")).withColumn(
        "least", least_hits(F.col("n"), F.col("size"), threshold)).where(F.size("hits") >= F.col("least"))
    found = F.filter(F.transform(
        F.sequence(F.lit(0), F.size("hits") - F.col("least")),
        lambda i: F.struct(
            F.get("hits", i).alias("at"),
            F.greatest(F.lit(0), F.coalesce(F.get("hits", i - 1) + 1, F.lit(0)),
                       F.get("hits", i + F.col("least") - 1) - F.col("size") + SHINGLE).alias("first"),
            F.least(F.get("hits", i), F.greatest(F.lit(0), F.col("n") - F.col("size"))).alias("last"))),
        lambda s: (s["first"] <= s["last"]) & (s["at"] < (F.col("block") + 1) * RANGE))
    return held.select(*KEY, "size", "block", F.transform(
        found, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))).alias("spans")).where(F.size("spans") > 0)


def windows(texts: DataFrame, places: DataFrame, most: int) -> DataFrame:
    """k1, k2, size, h1, h2, parts: the distinct windows of every range, with their shingle hashes."""
    keys, path = written(places.select(*KEY).distinct(), "texts-with-windows")
    near = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    one = texts.join(near, KEY).groupBy(*KEY).agg(F.first("text").alias("text"))
    hashed = one.select(*KEY, word_hashes("text").alias("words")).select(*KEY, shingle_hashes("words").alias("parts"))
    # a range begins an item before its first place
    ranges, _ = written(hashed.select(*KEY, "parts", F.explode(F.sequence(
        F.lit(0), F.expr(f"(size(parts) - 1) div {RANGE}").cast("int"))).alias("block")).select(
        *KEY, "block", F.greatest(F.lit(0), F.col("block") * RANGE - most).alias("low"), "parts").select(
        *KEY, "block", "low", F.slice("parts", F.col("low") + 1, F.lit(RANGE + 2 * most)).alias("parts")), "text-ranges")
    drop_written(texts.sparkSession, path)
    # One row a window, outside of any lambda function: there a slice would turn
    # the whole range into objects first.
    begins = "explode(flatten(transform(spans, s -> sequence(s.first, s.last))))"
    part = f"slice(parts, b - low + 1, size - {SHINGLE - 1})"
    placed = places.join(ranges, [*KEY, "block"]).select(*KEY, "size", "block", "low", "parts", F.expr(begins).alias("b"))
    marked = placed.select(*KEY, "size", "block", "b", F.expr(part).alias("parts")).select(
        *KEY, "size", "block", "b", F.xxhash64("parts").alias("h1"), F.xxhash64(F.lit(1), "parts").alias("h2"))
    first = marked.groupBy(*KEY, "size", "block", "h1", "h2").agg(F.min("b").alias("b"))
    return first.join(ranges, [*KEY, "block"]).select(*KEY, "size", "h1", "h2", F.expr(part).alias("parts"))


def text_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
                 radius: int = RADIUS) -> DataFrame:
    """k1, k2, item_id, similarity of every distinct text that holds a benchmark item."""
    items, path = written(benchmark.where("item_id is not null").select(
        "item_id", word_hashes("text").alias("words")).where(F.size("words") >= SHINGLE).distinct().select(
        "item_id", F.size("words").alias("size"), shingle_hashes("words").alias("item_parts")), "items")
    seeds = items.select(F.explode("item_parts").alias("hash"), "size").distinct()
    most = items.agg(F.max("size")).first()[0] or SHINGLE
    if seeds.count() <= BROADCAST_SHINGLES:
        seeds = F.broadcast(seeds)

    texts = docs.where("text is not null").select(*text_key(), "text")
    places, _ = written(spans(texts, seeds, threshold), "window-places")
    held, _ = written(windows(texts, places, most), "windows")
    window = ["size", "h1", "h2"]
    distinct, _ = written(held.groupBy(*window).agg(F.first("parts").alias("parts")).withColumn(
        "fp", fingerprint("parts", most)), "distinct-windows")
    wanted, _ = written(items.withColumn("item_fp", fingerprint("item_parts", most)), "item-prints")
    index = wanted.select("item_id", "size", "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("b"))
    pairs = distinct.select(*window, "fp", F.explode(blocks(F.col("fp"), radius)).alias("b")).join(index, ["size", "b"]).where(
        F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*window, "item_id", "item_fp").distinct()
    near = pairs.join(distinct.select(*window, "parts"), window).join(
        wanted.select("item_id", "size", "item_fp", "item_parts"), ["item_id", "size", "item_fp"])
    counted = near.select(*window, "item_id", F.size("parts").alias("n"), F.size("item_parts").alias("m"),
                          shared_count("parts", "item_parts").alias("shared"))
    scored = counted.select(*window, "item_id", (
        F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("similarity")).where(
        F.col("similarity") >= threshold).groupBy(*window, "item_id").agg(F.max("similarity").alias("similarity"))
    return held.select(*KEY, *window).join(scored, window).groupBy(*KEY, "item_id").agg(
        F.max("similarity").alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
            radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity of every document that holds a benchmark item."""
    found, _ = written(text_matches(docs, benchmark, threshold, radius), "matched-texts")
    if found.count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    return docs.where("doc_id is not null").select("doc_id", *text_key()).join(found, KEY).groupBy(
        "doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of the documents that match no item: rows whose text matches go,
    and with them all rows of their doc_id."""
    found, _ = written(text_matches(docs, benchmark).select(*KEY).distinct(), "matched-texts")
    known = docs.where("doc_id is not null").select("doc_id", *text_key()).join(_small(found), KEY, "left_semi")
    gone, _ = written(known.select("doc_id").distinct(), "dropped-ids")
    marked = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", *text_key()).join(_small(found), KEY, "left_anti")
    return marked.join(_small(gone), "doc_id", "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


#: Every window of every pair that shares a shingle, without fingerprints.
ORACLE = f"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(lower("text"), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w
  from documents where doc_id is not null and "text" is not null),
i as (
  select item_id, list_filter(regexp_split_to_array(lower("text"), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as w
  from benchmark where item_id is not null and "text" is not null),
ds as (select doc_id, w, unnest(range(1, len(w) - {SHINGLE} + 2)) as p from d),
its as (select item_id, len(w) as n, array_to_string(w[p:p + {SHINGLE - 1}], ' ') as s
        from (select item_id, w, unnest(range(1, len(w) - {SHINGLE} + 2)) as p from i)),
ic as (select item_id, n, s, count(*) as c from its group by all),
c as (
  select distinct ds.doc_id, ic.item_id, ic.n from ds
  join ic on ic.s = array_to_string(ds.w[ds.p:ds.p + {SHINGLE - 1}], ' ')),
wd as (
  select doc_id, item_id, n, w, unnest(range(1, greatest(len(w) - n + 1, 1) + 1)) as b
  from c join d using (doc_id)),
ws as (
  select doc_id, item_id, n, b, array_to_string(w[q:q + {SHINGLE - 1}], ' ') as s
  from (select *, unnest(range(b, least(b + n - 1, len(w)) - {SHINGLE} + 2)) as q from wd)),
wc as (select doc_id, item_id, n, b, s, count(*) as c from ws group by all),
m as (
  select wc.doc_id, wc.item_id, wc.n, wc.b, sum(wc.c) as windows, sum(least(wc.c, coalesce(ic.c, 0))) as shared
  from wc left join ic on ic.item_id = wc.item_id and ic.s = wc.s group by all)
select doc_id, item_id, max(shared::double / (windows + n - {SHINGLE - 1} - shared)::double) as similarity
from m group by all having max(shared::double / (windows + n - {SHINGLE - 1} - shared)::double) >= {THRESHOLD}
"""
