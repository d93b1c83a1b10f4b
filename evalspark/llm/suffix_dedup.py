"""Removal of repeated passages by prefix-free parsing and suffix arrays.

A byte goes if it is covered by a ``width``-byte string that also starts in a
document with a smaller doc_id. Texts are bytes (UTF-8), and strings never
cross documents.

Parsing: the rolling hash of every 24-byte gram is computed, and the smallest
hash among the grams of a ``width``-byte string is its trigger. A phrase is a
run of neighbouring strings with one trigger, with the bytes they reach: equal
strings have equal triggers, wherever they stand, and so meet in the bucket of
that trigger, while phrase borders follow the content.

1. Documents are packed into files of about ``PACK_BYTES`` in the shared
   folder. Only trigger hashes, phrases and results move afterwards; whole
   texts never cross a shuffle.
2. Each pack sends its distinct triggers (32 bits each) to hash buckets,
   which answer with those that stand in two documents or more.
3. Each pack sends its distinct phrases with such a trigger, once each, with
   the smallest doc_id it has them in.
4. A bucket joins the phrases of all packs into one dictionary of distinct
   phrases and ranks the dictionary's suffixes by prefix doubling up to depth
   ``width``: as every phrase brings the bytes its strings reach, this order
   is the corpus order to that depth. Suffixes of one rank are one string;
   its smallest doc_id goes back to the packs along their parse.
5. Each pack removes what its documents have from smaller ones.

A trigger with more than ``HOT_RUNS`` runs is dealt out by single strings
instead, each to the bucket of its own hash, so no group of one trigger holds
more phrases than that, and a passage, line or document that a third of the
corpus shares is sent once a pack.

Defined results: a null or empty text has 0 bytes and loses nothing; a row
with a null doc_id loses nothing and takes nothing from others; rows with
equal doc_ids take nothing from each other; bytes left that are no UTF-8 are
kept in ``kept`` (binary) and left out of the text of ``deduplicated``; other
columns are carried, and those named like an output column are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc as ipc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.graph import light, light_group, new_folder, written
from evalspark.llm.warc import _at

WIDTH = 50
GRAM = 24
PACK_BYTES = 1 << 22
SEGMENT_BYTES = 1 << 20
BUCKET_BYTES = 1 << 23
SLAB_BYTES = 1 << 20
LEAST_BUCKETS = 48
MOST_STRINGS = 64
HOT_RUNS = 50_000
NOBODY = np.iinfo(np.int64).max
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD
    return h ^ (h >> np.uint64(29))


def _flat(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), start[1], ..."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _sorted_out(low: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as zipped differences, byte by byte."""
    step = np.diff(low, prepend=np.uint32(0)).astype("<u4")
    return _packed(step.view(np.uint8).reshape(-1, 4).T.tobytes())[0]


def _sorted_in(blob: bytes) -> np.ndarray:
    step = np.frombuffer(_raw(blob), np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(step).view("<u4")[:, 0], dtype=np.uint32)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hash of the GRAM bytes from every place on, by doubling."""
    h, step, base = data.astype(np.uint64) + np.uint64(1), 1, 0x100000001B3
    eight = eight_base = None
    while step < 16:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base % (1 << 64), 2 * step
        if step == 8:
            eight, eight_base = h, base
    return _mix(h[:-8] * np.uint64(eight_base) + eight[16:])


def triggers(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Smallest gram hash of the ``width``-byte string at every place."""
    least, span, grams = gram_hashes(data), 1, width - GRAM + 1
    while 2 * span <= grams:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    rest = grams - span
    return np.minimum(least[:-rest], least[rest:]) if rest else least


class Pack:
    """Documents of one pack file and the phrases of its strings."""

    def __init__(self, path: str, width: int):
        store, where = _at(path)
        with store.open_input_file(where) as f, ipc.open_file(f) as reader:
            self.table = reader.read_all()
        self.width = width
        self.ids = self.table.column("doc_id").to_pylist()
        self.texts: list[bytes] = self.table.column("text").to_pylist()
        self.numbers = np.array([NOBODY if i is None else i for i in self.ids], np.int64)
        #: trigger, document, first place and number of strings of each run
        self.runs = [np.concatenate(c) for c in zip(*self._runs())]

    def _runs(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Runs of equal triggers, over texts laid end to end in segments."""
        yield (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for doc, text in enumerate(self.texts):
            if len(text) < self.width:
                continue
            step = SEGMENT_BYTES
            for at in range(0, max(len(text) - self.width + 1, 1), step):
                part = text if len(text) <= step else text[at:at + step + self.width - 1]
                held.append((doc, at, part))
                size += len(part)
                if size >= SEGMENT_BYTES:
                    yield self._segment(held)
                    held, size = [], 0
                if len(text) <= step:
                    break
        if held:
            yield self._segment(held)

    def _segment(self, parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        least = triggers(data, self.width)
        size = np.array([len(p[2]) for p in parts])
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(parts)), size)[:len(least)]
        place = np.arange(len(least)) - start[owner]
        inside = place <= size[owner] - self.width
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        count = np.add.reduceat(inside, np.flatnonzero(new))[inside[np.flatnonzero(new)]] if len(first) else first
        # long runs, as of one repeated character, are cut
        cuts = -(-count // MOST_STRINGS)
        again = np.repeat(np.arange(len(first)), cuts)
        turn = np.arange(len(again)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = first[again] + turn * MOST_STRINGS
        count = np.minimum(count[again] - turn * MOST_STRINGS, MOST_STRINGS)
        doc = np.array([p[0] for p in parts])[owner[begin]]
        at = np.array([p[1] for p in parts])[owner[begin]] + place[begin]
        return least[begin], doc.astype(np.int64), at.astype(np.int64), count.astype(np.int64)

    def distinct_triggers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mixed triggers, sorted, whether each stands in several documents,
        and the runs of each."""
        h = _mix(self.runs[0])
        order = np.lexsort((self.runs[1], h))
        h, doc = h[order], self.runs[1][order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[:len(h)])
        last = np.concatenate([first[1:], [len(h)]])[:len(first)] - 1
        return h[first], doc[first] != doc[last], last - first + 1

    def phrases(self, shared: np.ndarray, hot: np.ndarray, buckets: int):
        """Distinct phrases with a shared trigger, in an order of the pack's own.

        Returns bucket, trigger, bytes and smallest doc_id of each, and for
        every occurrence: phrase, document, place, strings.
        """
        h = _mix(self.runs[0])
        at = np.minimum(np.searchsorted(shared, h), max(len(shared) - 1, 0))
        found = np.flatnonzero(shared[at] == h) if len(shared) else np.zeros(0, np.int64)
        key, doc, place, count = (c[found] for c in (h, *self.runs[1:]))
        single = hot[at[found]]
        pieces = np.where(single, count, 1)
        place = _flat(place, pieces)
        key, doc, single, count = (np.repeat(c, pieces) for c in (key, doc, single, np.where(single, 1, count)))
        known: dict[bytes, int] = {}
        texts = self.texts
        phrase = np.array([known.setdefault(texts[d][a:b], len(known)) for d, a, b in zip(
            doc.tolist(), place.tolist(), (place + count + (self.width - 1)).tolist())], np.int64)
        bodies = list(known)
        first = np.full(len(bodies), NOBODY)
        np.minimum.at(first, phrase, self.numbers[doc])
        trigger, alone = np.zeros(len(bodies), np.uint64), np.zeros(len(bodies), bool)
        trigger[phrase], alone[phrase] = key, single
        bucket = ((trigger >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        for n in np.flatnonzero(alone).tolist():
            bucket[n] = xxhash.xxh64_intdigest(bodies[n]) % buckets
        return bucket, trigger, bodies, first, (phrase, doc, place, count)


def suffix_ranks(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """Rank of the ``width`` bytes from each of the first n places, in order;
    equal for equal strings. ``data`` goes on for 2 * width places at least.

    The suffix array's prefix doubling: places are sorted by 8 bytes, read as
    one number, and those that share a rank are sorted again by the rank of
    what follows; the last step overlaps the one before.
    """
    n += width
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= data[k:k + n].astype(np.uint64) << np.uint64(56 - 8 * k)
    rank, depth, part, old = np.zeros(n, np.int64), 8, np.arange(n), np.zeros(n, np.int64)
    while True:
        order = np.argsort(key)
        key, part, old = key[order], part[order], old[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        index = np.arange(len(key))
        begin = np.maximum.accumulate(np.where(new, index, 0))
        rank[part] = old + begin - np.maximum.accumulate(np.where(group, index, 0))
        if depth == width:
            return rank[:n - width]
        step = min(depth, width - depth)
        many = np.diff(np.concatenate([np.flatnonzero(new), [len(key)]]))
        part = part[np.repeat(many > 1, many)]
        old = rank[part]
        key = old.astype(np.uint64) * np.uint64(n + 1) + rank[np.minimum(part + step, n - 1)].astype(np.uint64)
        depth += step
        if not len(part):
            return rank[:n - width]


def smallest_doc(phrases: list[bytes], first: np.ndarray, width: int) -> np.ndarray:
    """For every string of every distinct phrase, one phrase after the other,
    the smallest doc_id that has it."""
    size = np.array([len(p) for p in phrases])
    rank = suffix_ranks(np.frombuffer(b"".join(phrases) + bytes(2 * width), np.uint8), int(size.sum()), width)
    strings = size - width + 1
    own = rank[_flat(np.cumsum(size) - size, strings)]
    least = np.full(int(own.max()) + 1, NOBODY)
    np.minimum.at(least, own, np.repeat(first, strings))
    return least[own]


def _packed(*arrays: np.ndarray | bytes) -> list[bytes]:
    zip_ = zstandard.ZstdCompressor(level=1)
    return [zip_.compress(a if isinstance(a, bytes) else a.tobytes()) for a in arrays]


def _raw(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def write_packs(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Files of whole documents with their columns; returns path and n_bytes of each.

    ``docs``: doc_id (bigint), text (binary, never null) and any other columns.
    """
    folder = new_folder(docs.sparkSession, "packs")

    def save(parts: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
        store, top = _at(folder)
        store.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.arrow"
        with store.open_output_stream(f"{top}/{name}") as out, ipc.new_file(
                out, parts[0].schema, options=ipc.IpcWriteOptions(compression="zstd")) as writer:
            for part in parts:
                writer.write_batch(part)
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_bytes": [size]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            begin = 0
            lengths = pc.binary_length(batch.column(batch.schema.get_field_index("text")))
            for i, n in enumerate(lengths.to_pylist()):
                size += n
                if size >= pack_bytes:
                    yield save([*parts, batch.slice(begin, i + 1 - begin)], size)
                    parts, size, begin = [], 0, i + 1
            if begin < batch.num_rows:
                parts.append(batch.slice(begin))
        if parts:
            yield save(parts, size)

    return written(docs.mapInArrow(light(run), "path string, n_bytes long"), "pack-list")[0]


def shared_triggers(packs: DataFrame, buckets: int, width: int, hot_runs: int = HOT_RUNS) -> DataFrame:
    """path, bucket, low (packed 32-bit rests of triggers that stand in two
    documents or more, sorted), hot (packed booleans)."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                h, many, runs = Pack(path, width).distinct_triggers()
                part, low = (h >> np.uint64(32)) % np.uint64(buckets), h.astype(np.uint32)
                order = np.lexsort((low, part))
                edges = np.searchsorted(part[order], np.arange(buckets + 1))
                # one byte each: several documents, and the next power of two above the runs
                about = (many * 128 + np.ceil(np.log2(runs + 1))).astype(np.uint8)
                rows = [(path, b, _sorted_out(low[own]), _packed(about[own])[0])
                        for b in range(buckets) if len(own := order[edges[b]:edges[b + 1]])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.binary()))],
                        ["path", "bucket", "low", "about"])

    def answered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lows = [_sorted_in(x) for x in rows["low"]]
        about = np.concatenate([np.frombuffer(_raw(x), np.uint8) for x in rows["about"]])
        value, back, packs_with = np.unique(np.concatenate(lows), return_inverse=True, return_counts=True)
        several = (packs_with > 1) | (np.bincount(back, about >= 128, len(value)) > 0)
        hot = np.bincount(back, np.exp2(about % 128), len(value)) > 2 * hot_runs
        out = []
        for path, low, own in zip(rows["path"], lows, np.split(back, np.cumsum([len(x) for x in lows])[:-1])):
            # two triggers of one pack may share their 32 bits
            low, once = np.unique(low[several[own]], return_index=True)
            if len(low):
                out.append((path, key[0], _sorted_out(low), np.packbits(hot[own[several[own]][once]]).tobytes()))
        return pd.DataFrame(out, columns=["path", "bucket", "low", "hot"])

    rows = packs.select("path").mapInArrow(light(sent), "path string, bucket int, low binary, about binary")
    return written(rows.groupBy("bucket").applyInPandas(
        light_group(answered), "path string, bucket int, low binary, hot binary"), "shared-triggers")[0]


def _shared(rows: pd.DataFrame, buckets: int, pack: Pack) -> tuple[np.ndarray, np.ndarray]:
    """The pack's mixed triggers that are shared, sorted, and which are hot."""
    h, _, _ = pack.distinct_triggers()
    part = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    low = h.astype(np.uint32)
    keep, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(buckets + 1))
    for b, lows, hots in zip(rows["bucket"], rows["low"], rows["hot"]):
        own = order[edges[b]:edges[b + 1]]
        lows = _sorted_in(lows)
        hots = np.unpackbits(np.frombuffer(hots, np.uint8))[:len(lows)].astype(bool)
        at = np.minimum(np.searchsorted(lows, low[own]), len(lows) - 1)
        same = lows[at] == low[own]
        keep[own], hot[own] = same, same & hots[at]
    return h[keep], hot[keep]


def repeats(docs: DataFrame, width: int = WIDTH, pack_bytes: int = PACK_BYTES,
            hot_runs: int = HOT_RUNS, as_text: bool = False) -> DataFrame:
    """All columns but text, and n_bytes, spans (begin, end of the removed runs),
    kept (the bytes that stay) of every document; ``as_text``: for kept, its
    whole characters as text."""
    if width < GRAM + 8:
        raise ValueError("the width must leave room for several grams")
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_bytes", "spans", "kept")]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), *others)
    packs = write_packs(rows, pack_bytes)
    total = packs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    slots = 2 * spark.sparkContext.defaultParallelism
    spread = packs.repartition(max(slots, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = shared_triggers(spread, buckets, width, hot_runs)

    def sent(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pack = Pack(key[0], width)
        bucket, trigger, bodies, first, _ = pack.phrases(*_shared(rows, buckets, pack), buckets)
        out = []
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[edges[b]:edges[b + 1]]
            if not len(own):
                continue
            texts = [bodies[i] for i in own]
            out.append((key[0], b, *_packed(trigger[own], np.array([len(t) for t in texts], np.uint32),
                                            first[own], b"".join(texts))))
        return pd.DataFrame(out, columns=["path", "bucket", "trigger", "size", "first", "body"])

    def ranked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        trigger: list[int] = []
        first: list[int] = []
        parse: list[np.ndarray] = []
        for row in rows.itertuples():
            size, body = np.frombuffer(_raw(row.size), np.uint32), _raw(row.body)
            edges = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).tolist()
            own = np.array([known.setdefault(body[a:b], len(known)) for a, b in zip(edges, edges[1:])], np.int64)
            parse.append(own)
            grown = len(known) - len(first)
            first += [NOBODY] * grown
            trigger += [0] * grown
            for n, t, f in zip(own.tolist(), np.frombuffer(_raw(row.trigger), np.uint64).tolist(),
                               np.frombuffer(_raw(row.first), np.int64).tolist()):
                trigger[n] = t
                if f < first[n]:
                    first[n] = f
        bodies, firsts = list(known), np.array(first, np.int64)
        known.clear()
        strings = np.array([len(b) for b in bodies]) - width + 1
        start = np.cumsum(strings) - strings
        least = np.zeros(int(strings.sum()), np.int64)
        order = np.argsort(np.array(trigger, np.uint64), kind="stable")
        slab: list[int] = []
        held = 0
        turn = order.tolist()
        for k, i in enumerate(turn):
            slab.append(i)
            held += len(bodies[i])
            if k + 1 == len(turn) or held >= SLAB_BYTES and trigger[turn[k + 1]] != trigger[i]:
                least[_flat(start[slab], strings[slab])] = smallest_doc([bodies[j] for j in slab], firsts[slab], width)
                slab, held = [], 0
        return pd.DataFrame([(path, key[0], _packed(least[_flat(start[own], strings[own])])[0])
                             for path, own in zip(rows["path"], parse)], columns=["path", "bucket", "least"])

    answers = found.groupBy("path").applyInPandas(
        light_group(sent), "path string, bucket int, trigger binary, size binary, first binary, body binary").groupBy(
        "bucket").applyInPandas(light_group(ranked), "path string, bucket int, least binary")

    def covered(pack: Pack, begin: np.ndarray, shared: pd.DataFrame, least: pd.DataFrame) -> np.ndarray:
        """Whether each byte goes, over the pack's texts laid end to end."""
        starts = np.zeros(int(begin[-1]) + 1, np.int32)
        if len(shared):
            bucket, _, bodies, _, (phrase, doc, place, count) = pack.phrases(
                *_shared(shared, buckets, pack), buckets)
            strings = np.array([len(b) for b in bodies], np.int64) - width + 1
            start = np.zeros(len(bodies), np.int64)
            values, at = [np.zeros(0, np.int64)], 0
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b, blob in zip(least["bucket"], least["least"]):
                own = order[edges[b]:edges[b + 1]]
                start[own] = at + np.cumsum(strings[own]) - strings[own]
                values.append(np.frombuffer(_raw(blob), np.int64))
                at += len(values[-1])
            known = np.array([i is not None for i in pack.ids])
            doc_of = np.repeat(doc, count)
            gone = (np.concatenate(values)[_flat(start[phrase], count)] < pack.numbers[doc_of]) & known[doc_of]
            starts[(_flat(place, count) + begin[doc_of])[gone]] = 1
        upto = np.cumsum(starts)
        upto[width:] -= upto[:-width].copy()
        return upto[:-1] > 0

    def finished(key: tuple, group: pa.Table) -> pa.Table:
        pack, group = Pack(key[0].as_py(), width), group.to_pandas()
        shared = group[group["kind"] == 1].rename(columns={"a": "low", "b": "hot"})
        least = group[group["kind"] == 2].rename(columns={"a": "least"})
        sizes = np.array([len(t) for t in pack.texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        out = covered(pack, begin, shared, least)
        spans, kept = [], []
        for text, a, b in zip(pack.texts, begin.tolist(), begin.tolist()[1:]):
            own = out[a:b]
            if own.any():
                edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                spans.append([{"begin": x, "end": y} for x, y in edge.tolist()])
                text = np.frombuffer(text, np.uint8)[~own].tobytes()
            else:
                spans.append([])
            kept.append(text)
        last = ("text", [k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else ("kept", kept, pa.binary())
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        result = pack.table.drop_columns(["text"])
        for name, values, kind in (("n_bytes", sizes, pa.int64()), ("spans", spans, span), last):
            result = result.append_column(name, pa.array(values, kind))
        return result.combine_chunks()

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("text", T.StringType()) if as_text else T.StructField("kept", T.BinaryType())])

    # One group a pack: its name, its shared triggers, the answers to its phrases.
    parts = spread.select("path", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("a"),
                          F.lit(None).cast("binary").alias("b")).unionByName(
        found.select("path", F.lit(1).alias("kind"), "bucket", F.col("low").alias("a"), F.col("hot").alias("b"))
    ).unionByName(answers.select("path", F.lit(2).alias("kind"), "bucket", F.col("least").alias("a"),
                                 F.lit(None).cast("binary").alias("b")))
    return parts.groupBy("path").applyInArrow(light_group(finished), schema)


def digests(docs: DataFrame, width: int = WIDTH, pack_bytes: int = PACK_BYTES,
            hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept."""
    return repeats(docs.select("doc_id", "text"), width, pack_bytes, hot_runs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The columns of ``docs`` with the texts that stay; a character that a
    removed run begins or ends inside of goes with it, and a null text comes
    back empty. n_chars, if there is one, is the new length of a text that
    was cut."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*rest) if rest else F.lit(None).cast("string")
    rows = repeats(docs.select("doc_id", "text", row.alias("row")), width, as_text=True)
    whole = F.size("spans") == 0

    def column(name: str) -> Column:
        if name in ("doc_id", "text"):
            return F.col(name)
        if name == "n_chars":
            size = F.length("text").cast(docs.schema[name].dataType)
            return F.when(whole, F.col("row")[name]).otherwise(size).alias(name)
        return F.col("row")[name].alias(name)

    return rows.select(*map(column, docs.columns))
