"""Spelling variants of the corpus's words, found over variable-length grams.

Words are counted in one pass over whole texts, with counts added up in each
task before their shuffle. Near words (one code point inserted, deleted or
replaced) are then found by a variable-length gram index:

1. Dictionary: all grams of two code points of the words (with a mark at
   either end), and each gram of the dictionary that more than ``limit``
   places hold is extended by one code point, up to ``LONGEST``. Rare grams
   are never extended: that is the pruning by frequency.
2. Decomposition: at every place of a word the longest gram of the dictionary.
3. Bound: an edit at place i changes the gram at i and those before it that
   reach i or could be extended to it, which is so exactly if the code points
   from their place up to i are a gram that was extended (or one code point).
   Grams behind the edit keep theirs. The largest number over all places and
   kinds of edits is the word's bound b; it is LONGEST at most, and a word of seven
   code points has eight grams, so near words always share grams.
4. Lists: two near words share all but b of the grams of each, so the rarest
   shared gram is among the b + 1 rarest places of either word; only those go into
   lists. A shared gram left of the edit has all of the word before it in common,
   one right of it all that follows: lists are kept by gram with that context, and
   a word enters both. So a frequent gram makes no long list by itself.
5. Words that meet in a list are verified by edit distance.

The number of extended grams, which every task holds, is bounded: their places
add up to at most LONGEST - 1 a place of a word, and ``limit`` grows with the words so
that at most ``MAX_GRAMS`` grams lie above it.

Defined results: null texts have no words; of a null id no code point is
deleted; equal rows (repeats) count each; words of one kind in several rows add
up; other columns are not carried; an empty table gives an empty result.
Only A-Z are lower-cased. Texts are read in pieces cut between words, and a run of
letters of any length is one word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil, log2, log10
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from evalspark.llm.graph import light, written

SHORTEST, LONGEST = 2, 4
ENDS = 2
MAX_GRAMS = 200_000
LEAST_LIMIT = 32
#: Distinct words added up in a worker before they are passed on.
HELD_WORDS = 300_000
PIECE_BYTES = 1 << 22
#: Marks before and after a word; no letter.
BEGIN, END = "^", "$"
#: Runs of letters and of bytes that may belong to one; A-Z are lower case by then.
SPAN = re.compile(rb"[a-z\x80-\xff]+")
RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text's bytes, cut where no run of letters goes on."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        stop = re.compile(rb"[^a-z\x80-\xff]").search(data, end)
        end = stop.start() if stop else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def runs(text: str, least: int) -> Counter:
    """Runs of letters of at least ``least`` code points, A-Z lower-cased, with their number."""
    found: Counter = Counter()
    for piece in _pieces(text.encode().lower()):
        spans = Counter(s for s in SPAN.findall(piece) if len(s) >= least)
        for span, n in spans.items():
            for run in [span] if span.isascii() else RUN.findall(span):
                found[run] += n
    return Counter({word: n for run, n in found.items() if len(word := run.decode()) >= least})


def slipped(doc_id: int | None, run: str, every: int) -> str:
    """The run, without one code point where ``every`` divides its hash with the id."""
    if doc_id is None:
        return run
    h = crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least: int = 7, every: int = 31) -> DataFrame:
    """word, n: the words of at least ``least`` code points and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                               pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for found, n in runs(text.as_py() or "", least).items():
                    word = slipped(doc_id, found, every)
                    if len(word) >= least:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    return rows.mapInArrow(light(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, places: of every gram that a word holds, and in how many places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                               pa.array(list(held.values()), pa.int64())], ["gram", "places"])

        for batch in batches:
            for word in batch.column(0):
                w = BEGIN + word.as_py() + END
                for k in range(SHORTEST, LONGEST + 1):
                    held.update(w[p:p + k] for p in range(len(w) - k + 1))
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    return words.select("word").mapInArrow(light(run), "gram string, places long").groupBy("gram").agg(
        F.sum("places").alias("places"))


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The grams in more places than the limit, at most ``MAX_GRAMS``, with their places."""
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    limit = max(LEAST_LIMIT, ceil(places * (LONGEST - SHORTEST + 1) / MAX_GRAMS))
    return {r.gram: r.places for r in gram_counts(words).where(F.col("places") > limit).collect()}


def decompose(word: str, frequent: dict[str, int]) -> tuple[list[str], int]:
    """The gram at each place of the marked word, and the bound of an edit."""
    w = BEGIN + word + END
    n = len(w)
    grams, reach = [], []
    for p in range(n - 1):
        end = p + SHORTEST
        while end < n and end - p < LONGEST and w[p:end] in frequent:
            end += 1
        grams.append(w[p:end])
        # places behind p where an edit changes the gram: an extended part ends there
        reach.append(end - 1)
    bound = 0
    for i in range(1, n):  # a code point replaced or deleted at i, or one put in before it
        open_ = sum(reach[p] >= i for p in range(max(0, i - LONGEST), i) if p < len(reach))
        bound = max(bound, open_ + (i < n - 1))
    return grams, bound


def entries(word: str, frequent: dict[str, int]) -> set[int]:
    """Hashes of the lists that the word enters: each of its rarest grams with
    all of the word up to its first place, and with all from its last place on.

    Of a gram's places left of an edit the first is the gram's first place in
    both words, and of those right of it the last is the last in both.
    """
    w = BEGIN + word + END
    grams, bound = decompose(word, frequent)
    order = sorted(range(len(grams)), key=lambda p: (frequent.get(grams[p], 0), -len(grams[p]), grams[p]))
    chosen = {grams[p] for p in order[:bound + 1]}
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for p, gram in enumerate(grams):
        if gram in chosen:
            first.setdefault(gram, p)
            last[gram] = p
    tail, head, n = word[-ENDS:], word[:ENDS], max(len(word), ENDS)
    contexts = [f"<{len(g)}{w[:p + len(g)]} {tail}" for g, p in first.items()]
    contexts += [f">{len(g)}{w[p:]} {head}" for g, p in last.items()]
    contexts += [f"{mark}{part}" for mark, part in (("b", word[:n - ENDS]), ("b", word[:n - ENDS + 1]),
                                                    ("e", word[ENDS:]), ("e", word[ENDS - 1:]))]
    return {xxh64_intdigest(c) - (1 << 63) for c in contexts}


def near_words(words: DataFrame) -> DataFrame:
    """a, b (a < b): all pairs of words one code point apart."""
    shared = words.sparkSession.sparkContext.broadcast(frequent_grams(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            lists, owners = [], []
            for word in batch.column(0).to_pylist():
                found = entries(word, frequent)
                lists += found
                owners += [word] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(owners, pa.string())], ["list", "word"])

    index, _ = written(words.select("word").mapInArrow(light(run), "list long, word string"), "gram-lists")
    longer = index.groupBy("list").count().where("count > 1").select("list")
    index = index.join(longer, "list", "left_semi")
    other = index.select("list", F.col("word").alias("b"))
    return index.withColumnRenamed("word", "a").join(other, "list").where(
        (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1)
        & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def _roots(forms: DataFrame, largest: int) -> DataFrame:
    """word, root: forms followed to the last. Counts grow tenfold from a word to
    its form, so their logarithm bounds the steps, each of which doubles the way."""
    now = forms.select("word", F.col("form").alias("root"))
    steps = max(1, int(log10(max(largest, 1))) + 1)
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now, _ = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def variants(docs: DataFrame, least: int = 7, every: int = 31, twice: int = 2, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs ``twice`` at least."""
    words, _ = written(word_counts(docs, least, every).where(F.col("n") >= twice), "words")
    pairs, _ = written(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    best = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.col("best.other")).alias("form"),
        F.when(-F.col("best.less") >= times * F.col("n"), -F.col("best.less")).alias("form_n"))
    judged, _ = written(judged, "word-forms")
    largest = judged.agg(F.max("form_n")).first()[0] or 0
    roots = _roots(judged.where("form is not null"), largest)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
