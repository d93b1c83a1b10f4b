"""SimHash near-dedup by bit-sliced comparison.

Fingerprints: ASCII letters lower-cased, words are runs without ASCII white
space, shingles are ``width`` words joined by one space (a shorter text is
one shingle), hashed with XXH64 under ``seed``; a bit is set if it is set in
over half of the shingle hashes, repeats included.

Links: any two fingerprints within ``radius`` bits agree on all the bits of
some choice of bands, so every pair meets in a bucket of one of the tables
made from those choices. Buckets are laid out one after another as vertical
bit planes and compared with themselves moved by 1, 2, 3, ... places, 64
pairs a machine word. Full adders keep the distances as bitwise counters,
and words whose pairs all exceed the radius are left out after every eight
planes. Equal fingerprints are one row beforehand; a bucket above
``BLOCK_ROWS`` is split into blocks that are compared two by two. A task
returns a spanning forest of the links it finds, never all pairs.

Defined results: a null or empty text, or one of white space alone, has
fingerprint zero and is linked like any other; a row with a null doc_id
links others and takes the component of its fingerprint, which is null only if
no row of it has an id; repeated rows each come back; other columns are not
carried; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.graph import Forest, components, light, without, written

BLOCK_ROWS = 8192
SLAB_ROWS = 1 << 16
#: Fingerprints that a table's buckets hold on average, at most.
BUCKET_ROWS = 4096
PIECE_BYTES = 1 << 22
WHITE = b" \t\n\r\x0b\x0c"


def _word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, piece by piece, cut at white space."""
    at = 0
    while len(data) - at > PIECE_BYTES:
        cut = max(data.rfind(bytes([w]), at, at + PIECE_BYTES) for w in WHITE)
        if cut < 0:
            after = [i for w in WHITE if (i := data.find(bytes([w]), at + PIECE_BYTES)) >= 0]
            if not after:
                break
            cut = min(after)
        yield data[at:cut].split()
        at = cut + 1
    yield data[at:].split()


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a whole text."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _word_pieces((text or "").encode().lower()):
        words = tail + words
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
            hashes = np.array([digest(s, seed) for s in shingles], "<u8")
            for i in range(0, len(hashes), 1 << 16):
                bits = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8), bitorder="little")
                ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
            n += len(hashes)
        tail = words[-(width - 1):] if width > 1 else []
    if not n and tail:
        n = 1
        ones += np.unpackbits(np.array([digest(b" ".join(tail), seed)], "<u8").view(np.uint8),
                              bitorder="little")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id (of any type) and fingerprint (as bigint) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("<i8"))],
                                             ["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(light(run), T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def tables(n: int, radius: int) -> list[int]:
    """Bit masks, one of which any two fingerprints within the radius agree on.

    ``bands`` bands with ``bands - radius`` of them in a mask; more bands make
    longer keys in more tables, so their number follows that of the rows.
    """
    for bands in range(radius + 1, 65):
        edges = [64 * i // bands for i in range(bands + 1)]
        if n <= BUCKET_ROWS << edges[bands - radius] or bands >= 2 * radius + 4:
            break
    spans = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(pick) for pick in combinations(spans, bands - radius)]


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits in each place."""
    odd = a ^ b
    return odd ^ c, (a & b) | (odd & c)


def planes(prints: np.ndarray) -> np.ndarray:
    """Vertical layout: row b holds bit b of all fingerprints, 64 to a word."""
    n = len(prints)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    wide = np.zeros((64, 64 * (-(-n // 64) + 1)), np.uint8)
    wide[:, :n] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def near(prints: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Waves of places i, j of one group within the radius. ``group`` is sorted."""
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold a radius of 0 to 7")
    n = len(prints)
    if n < 2:
        return
    plane = planes(prints)
    last = np.searchsorted(group, group, side="right") - 1
    room = np.zeros(64 * (plane.shape[1] - 1), np.int64)
    room[:n] = last - np.arange(n)
    most = room.reshape(-1, 64).max(axis=1)
    words = np.flatnonzero(most > 0)
    lanes = np.arange(64)
    for move in range(1, int(most.max(initial=0)) + 1):
        words = words[most[words] >= move]
        at = words
        live = np.packbits(room.reshape(-1, 64)[at] >= move, axis=1, bitorder="little").view("<u8")[:, 0]
        skip, part = divmod(move, 64)
        ones, twos, fours, over = (np.zeros(len(at), "<u8") for _ in range(4))
        for first in range(0, 64, 8):
            own = plane[first:first + 8, at]
            low = plane[first:first + 8, np.minimum(at + skip, plane.shape[1] - 1)]
            if part:
                high = plane[first:first + 8, np.minimum(at + skip + 1, plane.shape[1] - 1)]
                low = (low >> np.uint64(part)) | (high << np.uint64(64 - part))
            differ = own ^ low
            for k in (0, 4):
                ones, two_a = _add(ones, differ[k], differ[k + 1])
                ones, two_b = _add(ones, differ[k + 2], differ[k + 3])
                twos, four = _add(twos, two_a, two_b)
                over |= fours & four
                fours ^= four
            live &= ~(over | _exceeds(ones, twos, fours, radius))
            keep = live != 0
            if not keep.all():
                at, live, ones, twos, fours, over = (x[keep] for x in (at, live, ones, twos, fours, over))
                if not len(at):
                    break
        if len(at):
            word, lane = np.nonzero((live[:, None] >> lanes.astype("<u8")) & np.uint64(1))
            i = at[word] * 64 + lane
            yield i, i + move


def _exceeds(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Where the three-bit count is above the radius."""
    above, equal = np.zeros_like(ones), ~np.zeros_like(ones)
    for bit, counter in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            equal &= counter
        else:
            above |= equal & counter
            equal &= ~counter
    return above


def _forest(rows: list[np.ndarray], radius: int) -> pa.RecordBatch:
    """Links between fingerprints inside a slab of whole groups."""
    table, key, low, high, fp = rows
    new = np.ones(len(fp), bool)
    new[1:] = False
    for col in (table, key, low, high):
        new[1:] |= col[1:] != col[:-1]
    forest = Forest(len(fp))
    for i, j in near(fp.view("<u8"), np.cumsum(new), radius):
        forest.join(i, j)
    linked = np.flatnonzero(forest.label != np.arange(len(fp)))
    return pa.RecordBatch.from_arrays(
        [pa.array(fp[linked]), pa.array(fp[forest.label[linked]])], ["a", "b"])


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size < SLAB_ROWS:
                continue
            rows = [np.concatenate(c) for c in zip(*held)]
            same = np.ones(size, bool)
            for col in rows[:4]:
                same &= col == col[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield _forest([c[:cut] for c in rows], radius)
            held, size = [[c[cut:] for c in rows]], size - cut
        if size:
            yield _forest([np.concatenate(c) for c in zip(*held)], radius)
    return run


def links(uniq: DataFrame, n: int, radius: int) -> DataFrame:
    """Spanning links ``a``, ``b`` between near fingerprints.

    ``uniq``: fp, one row per fingerprint, whoever carries it; ``n``: their number.
    """
    masks = tables(n, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = uniq.select("fp", F.explode(F.array(*(
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for t, m in enumerate(signed)))).alias("k")).select("k.t", "k.key", "fp")
    hot = rows.groupBy("t", "key").count().where(F.col("count") > BLOCK_ROWS).select(
        "t", "key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rows.join(hot, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("t", "key", F.least("own", "other").alias("low"),
                       F.greatest("own", "other").alias("high"), "fp")
    parts = max(int(uniq.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                ceil(n * len(masks) / (16 * SLAB_ROWS)))
    return rows.repartition(parts, "t", "key", "low", "high").sortWithinPartitions(
        "t", "key", "low", "high").mapInArrow(light(_links(radius)), "a long, b long")


def classes(prints: DataFrame, radius: int = 4) -> DataFrame:
    """fp, component_id of every fingerprint of ``prints`` (doc_id, fp)."""
    uniq, _ = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    # A component is named by a fingerprint first; its smallest doc_id is sought
    # afterwards, so that fingerprints of rows without an id link others too.
    linked = components(links(uniq.select("fp"), uniq.count(), radius))
    named, _ = written(uniq.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component")), "classes")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(smallest, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per document."""
    prints, _ = written(fingerprints(docs, width, seed), "fingerprints")
    return prints.join(classes(prints, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """All columns of one document of each component, that with the smallest
    doc_id, and all rows of an id that stays. Rows without an id go where a
    document with one is in their component, and stay where none is."""
    prints, _ = written(fingerprints(docs, width, seed), "fingerprints")
    groups, _ = written(classes(prints, radius), "component-of-fingerprint")
    gone = prints.join(groups, "fp").where("doc_id <> component_id").select("doc_id")
    kept = without(docs.where("doc_id is not null"), gone)
    unnamed = docs.where("doc_id is null")
    row = unnamed.select(F.struct(*docs.columns).alias("doc_id"), F.col("text"))
    alone = groups.where("component_id is null").select("fp")
    lone = fingerprints(row, width, seed).join(alone, "fp", "left_semi")
    return kept.unionByName(lone.select(*(F.col("doc_id")[c].alias(c) for c in docs.columns)))
