"""Token ids in files of directly addressable codes.

An id is split into chunks from its lowest bits on. Level 0 holds the first
chunk of every id, level 1 the second chunk of those ids that have one, and
so on; a bitmap beside each level but the last marks the ids that go on, and
a rank directory holds the marks before every 512 of them. The place of an
id's next chunk is the number of marks before it, so any id is found by one
chunk, one directory entry and at most 64 bytes of bitmap a level, without
decoding a block, and a run of ids is one slice a level.

Files hold documents in ascending order of their key. Ranges of keys are found
first; texts are encoded where they lie, and packed ids are dealt by range and
sorted. A range is written in files of up to ``FILE_IDS`` ids (or one longer
document), whose names are unique to a task attempt; the manifest, a table that
Spark commits, names those of the attempts that succeeded. The driver sees the
bounds of the ranges and the number of ids of each, no more.

Ids come from the tokenizers library. Its normalisation and split pattern
never look across a space. Plain stretches of a text are therefore split here and
what the pattern finds goes to the library's BPE model; a piece with anything else
goes to the library whole. Both are remembered in bounded caches; ``tests/llm``
holds them against whole texts. Between tasks ids of small vocabularies travel in
16 bits.

Defined results: a null text is empty, so its document is the end id alone; null
keys come first; documents of one key come in order of a hash of their texts,
by which a key with very many documents is dealt over several ranges;
repeated rows are each a document; other columns are not written; an empty
table makes no file. A text without white space is encoded in one piece.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.graph import light, new_folder, written
from evalspark.llm.warc import _at

#: Characters of text handled together; pieces remembered in a worker, twice at
#: most; characters of a piece that is not remembered.
CHUNK_CHARS = 1 << 21
CACHE_PIECES = 300_000
LONG_PIECE = 256
#: Ids of a file, at most, unless one document has more. Bytes of text of a range of
#: keys on average, and ranges at most (beyond it they grow).
FILE_IDS = 1 << 23
PART_BYTES = 1 << 27
MAX_PARTS = 10_000
#: Ids read and decoded together.
READ_IDS = 1 << 20

#: Fixed values of the format.
MAGIC = b"DACTOK01"
WIDTHS = (8, 8, 16)
BLOCK_BITS = 512
KINDS = {8: "<u1", 16: "<u2", 32: "<u4"}
MANIFEST = "part int, file int, path string, part_start long, n_docs long, n_ids long"


#: Printable ASCII and Latin-1 letters: stretches of these are lower-cased and split
#: here, and what the split pattern finds goes to the library's BPE model.
PLAIN = r"\x20-\x7eÀ-ÖØ-öø-ÿ"
#: The vocabulary's normalisation and split pattern that this holds for.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 ]+")


def _byte_alphabet() -> list[str]:
    """Printable stand-ins of the 256 bytes: printable ones stand for
    themselves, the others for the code points from 256 on."""
    out, hidden = [], 256
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b if shown else hidden))
        hidden += not shown
    return out


class _Cache(dict):
    """Packed ids by text. A full half becomes the older one, from which what is
    still in use moves on; long texts are not remembered."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= LONG_PIECE:
            self[text] = ids
        return ids

    def trim(self) -> None:
        if len(self) > CACHE_PIECES:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Packed ids of whole texts, by the pieces that are encoded apart from each other."""

    def __init__(self, path: str, bits: int = 32):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        known_form = (
            spec["normalizer"] == NORMALIZER and split.get("pattern", {}).get("Regex") == PATTERN
            and split["behavior"] == "Removed" and split["invert"] and len(rest) == 1
            and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"])
        if not known_form and not _cuts_at_spaces(spec):
            raise ValueError("texts of this vocabulary cannot be cut at white space")
        # all but spaces is odd in an unknown form, as is the begin of an added token in the known one
        first = re.escape("".join({t["content"][:1] for t in spec["added_tokens"]}))
        self.odd = re.compile(f"[^{PLAIN}]" + (f"|[{first}]" if first else "") if known_form else "[^ ]").search
        self.letters = str.maketrans({chr(c): "".join(_byte_alphabet()[b] for b in chr(c).encode()) for c in range(128, 256)})
        self.letter = {16: "H", 32: "I"}[bits]
        self.tokens, self.pieces = _Cache(self._token), _Cache(self._piece)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _token(self, token: str) -> bytes:
        """Ids of one find of the split pattern."""
        return self._pack([t.id for t in self.library.model.tokenize(
            token if token.isascii() else token.translate(self.letters))])

    def _piece(self, piece: str) -> bytes:
        """Ids of any text without spaces."""
        return self._pack(self.library.encode(piece, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """Little-endian ids of a text."""
        out = []
        for part in _parts(text or ""):
            at = 0
            while at < len(part):
                odd = self.odd(part, at)
                begin = len(part) if odd is None else max(at, part.rfind(" ", at, odd.start()) + 1)
                out += map(self.tokens.__getitem__, PLAIN_SPLIT.findall(part[at:begin].lower()))
                if odd is not None:
                    end = part.find(" ", begin)
                    end = len(part) if end < 0 else end
                    out.append(self.pieces[part[begin:end]])
                    begin = end
                at = begin
            self.tokens.trim()
            self.pieces.trim()
        return b"".join(out)


def _cuts_at_spaces(spec: dict) -> bool:
    """Whether spaces are dropped before anything is merged, so that pieces are independent."""
    kind = (spec.get("pre_tokenizer") or {}).get("type")
    return spec.get("normalizer") is None and kind in ("Whitespace", "WhitespaceSplit")


def _parts(text: str) -> Iterator[str]:
    """A text with plain spaces for line breaks and tabs, cut at spaces."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK_CHARS:
            end = max(text.rfind(c, at, at + CHUNK_CHARS) for c in " \n")
            if end <= at:
                after = [p for c in " \n" if (p := text.find(c, at + CHUNK_CHARS)) >= 0]
                end = min(after, default=len(text))
        yield text[at:end].replace("\n", " ").replace("\t", " ").replace("\r", " ")
        at = end + 1


@lru_cache(maxsize=1)
def _encoder(path: str, bits: int) -> Encoder:
    return Encoder(path, bits)


def id_bits(vocab_path: str, end_id: int | None = None) -> int:
    """16 if all ids of the vocabulary fit, else 32."""
    with open(vocab_path, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id or 0])
    return 16 if most < 1 << 16 else 32


def encode(docs: DataFrame, vocab_path: str, end_id: int | None = None, bits: int = 32, text: str = "text",
           also: dict[str, Callable[[pa.RecordBatch], pa.Array]] | None = None, kinds: str = "") -> DataFrame:
    """The rows with ``ids`` (packed, little-endian, unsigned, of ``bits`` bits; ``end_id``
    after each document's) in place of the text.

    ``also``: columns (of the types ``kinds``) made from a batch of the other columns in the
    same pass, so that a task needs one worker.
    """
    tail = b"" if end_id is None else struct.pack("<H" if bits == 16 else "<I", end_id)
    others = [c for c in docs.columns if c not in (text, "ids")]
    made = also or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocab_path, bits)
        for batch in batches:
            for at, n in _groups(batch.column(0)):
                part = batch.slice(at, n)
                packed = [encoder.encode(t.as_py()) + tail for t in part.column(0)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *(make(part) for make in made.values()), pa.array(packed, pa.binary())],
                    [*others, *made, "ids"])

    rows = docs.select(text, *others)
    return rows.mapInArrow(light(run), T.StructType([*rows.schema.fields[1:], *T.StructType.fromDDL(kinds or "x int").fields[:len(made)],
                                              T.StructField("ids", T.BinaryType())]))


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and length of runs of texts of about ``CHUNK_CHARS`` bytes."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= CHUNK_CHARS:
            yield begin, i + 1 - begin
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts) - begin


def levels(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: chunks, continuation bitmap (bytes, lowest bit first), rank directory."""
    out = []
    rest = ids.astype(np.uint32, copy=False)
    for i, width in enumerate(widths):
        chunk = (rest & np.uint32((1 << width) - 1)).astype(KINDS[width])
        if i + 1 == len(widths):
            out.append((chunk, np.zeros(0, np.uint8), np.zeros(0, "<u8")))
            if width < 32 and (rest >> np.uint32(width)).any():
                raise ValueError("an id has more bits than the levels")
            break
        high = rest >> np.uint32(width)
        more = high != 0
        bits = np.packbits(more, bitorder="little")
        marks = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS), dtype=np.int64) if len(more) else []
        out.append((chunk, bits, np.concatenate([[0], np.cumsum(marks)]).astype("<u8")))
        rest = high[more]
    return out


def pack(keys: list[int | None], counts: np.ndarray, ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[bytes]:
    """A file's bytes: head, section ends, keys and their nulls, starts, levels."""
    sections = [np.array([k or 0 for k in keys], "<i8").tobytes(),
                np.packbits([k is None for k in keys], bitorder="little").tobytes() if keys else b"",
                np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes()]
    for level in levels(ids, widths):
        sections += [part.tobytes() for part in level]
    ends = np.cumsum([len(s) for s in sections]).astype("<u8")
    head = MAGIC + struct.pack("<QQI", len(keys), len(ids), len(widths)) + bytes(widths)
    return [head + ends.tobytes(), *sections]


class TokenFile:
    """Documents, runs of ids and single ids of a file, read where they lie."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        fixed = len(MAGIC) + 20
        head = self._read(0, fixed)
        if head[:len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        self.n_docs, self.n_ids, n = struct.unpack("<QQI", head[len(MAGIC):])
        self.widths = tuple(self._read(fixed, n))
        size = 8 * (3 + 3 * n)
        ends = np.frombuffer(self._read(fixed + n, size), "<u8").astype(np.int64)
        self.at = [fixed + n + size + int(e) for e in np.concatenate([[0], ends[:-1]])]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _array(self, section: int, kind: str, begin: int, end: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self._read(self.at[section] + begin * size, (end - begin) * size), kind)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Keys, and the place of each document's first id, with the end of the last."""
        nulls = np.unpackbits(self._array(1, "u1", 0, -(-self.n_docs // 8)), bitorder="little")
        keys = [None if null else k for k, null in zip(self._array(0, "<i8", 0, self.n_docs).tolist(), nulls)]
        return keys, self._array(2, "<u8", 0, self.n_docs + 1).astype(np.int64)

    def _rank(self, level: int, i: int) -> int:
        """Marks before place ``i`` of a level."""
        block, place = divmod(i, BLOCK_BITS)
        before = int(self._array(5 + 3 * level, "<u8", block, block + 1)[0])
        bits = self._array(4 + 3 * level, "u1", block * BLOCK_BITS // 8, -(-i // 8)) if place else np.zeros(0, np.uint8)
        return before + int(np.unpackbits(bits, bitorder="little")[:place].sum())

    def ids(self, begin: int, end: int, level: int = 0) -> np.ndarray:
        """Ids of the places from ``begin`` to ``end``: one slice a level."""
        if end <= begin:
            return np.zeros(0, np.uint32)
        out = self._array(3 + 3 * level, KINDS[self.widths[level]], begin, end).astype(np.uint32)
        if level + 1 < len(self.widths):
            first = begin // 8
            bits = np.unpackbits(self._array(4 + 3 * level, "u1", first, -(-end // 8)), bitorder="little")
            more = bits[begin - 8 * first:end - 8 * first].astype(bool)
            if n := int(more.sum()):
                at = self._rank(level, begin)
                out[more] |= self.ids(at, at + n, level + 1) << np.uint32(self.widths[level])
        return out

    def id(self, i: int) -> int:
        """One id, at random."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = shift = 0
        for level, width in enumerate(self.widths):
            out |= int(self._array(3 + 3 * level, KINDS[width], i, i + 1)[0]) << shift
            if level + 1 == len(self.widths):
                break
            if not self._array(4 + 3 * level, "u1", i // 8, i // 8 + 1)[0] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + width
        return out


def _write(store: fs.FileSystem, top: str, folder: str, rows: list[tuple[int | None, bytes]], bits: int) -> tuple[str, int]:
    name = f"{uuid.uuid4().hex}.ids"
    counts = np.array([len(b) * 8 // bits for _, b in rows])
    ids = np.frombuffer(b"".join(b for _, b in rows), KINDS[bits])
    with store.open_output_stream(f"{top}/{name}", compression=None) as out:
        for part in pack([k for k, _ in rows], counts, ids):
            out.write(part)
    return f"{folder}/{name}", len(ids)


def bounds(docs: DataFrame, key: str, text: str) -> list[int]:
    """Keys that part the documents into ranges of about equal number, in order; a
    key with very many documents is there several times."""
    slots = docs.sparkSession.sparkContext.defaultParallelism
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, min(MAX_PARTS, max(ceil(size / PART_BYTES), min(4 * slots, ceil(size / READ_IDS)))))
    if n == 1:
        return []
    return sorted(docs.where(F.col(key).isNotNull()).agg(F.percentile_approx(
        F.col(key).cast("long"), [i / n for i in range(1, n)], 10 * n)).first()[0] or [])


def bucket(places: np.ndarray, keys: pa.Array, ties: pa.Array) -> pa.Array:
    """The range of each document; those of a key that fills several ranges are dealt
    among them by ``ties``, a hash of their text, in order. Null keys are range 0."""
    known = keys.is_valid().to_numpy(zero_copy_only=False)
    k = keys.fill_null(0).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(places, k, "left"), np.searchsorted(places, k, "right")
    share = (ties.to_numpy(zero_copy_only=False).astype(np.float64) + 2.0 ** 63) / 2.0 ** 64
    inside = np.minimum(low + np.floor(share * (high - low + 1)), high)
    return pa.array(np.where(known, inside + 1, 0).astype(np.int32))


def write_ids(docs: DataFrame, vocab_path: str, end_id: int | None = None, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """Encodes the texts and writes their ids in ascending order of the key;
    returns the files' manifest: part, file, path, start, n_docs, n_ids."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    bits = id_bits(vocab_path, end_id)
    order = ["bucket", F.col("key").asc_nulls_first(), "tie"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _at(folder)
        store.create_dir(top, recursive=True)
        part, done, start, size = None, [], 0, 0
        held: list[tuple[int | None, bytes]] = []

        def flush() -> None:
            nonlocal start, size
            if held:
                path, n = _write(store, top, folder, held, bits)
                done.append((part, len(done), path, start, len(held), n))
                start, size = start + n, 0
                held.clear()

        for batch in batches:
            for bucket, k, ids in zip(*batch.columns):
                if bucket.as_py() != part:
                    flush()
                    part, start = bucket.as_py(), 0
                held.append((k.as_py(), ids.as_py()))
                size += len(held[-1][1]) * 8 // bits
                if size >= FILE_IDS:
                    flush()
        flush()
        names = ["part", "file", "path", "part_start", "n_docs", "n_ids"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)] if done else
                                         [pa.array([], t) for t in kinds], names)

    rows = docs.select(text, F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tie"))
    shared = spark.sparkContext.broadcast(np.array(bounds(docs, key, text), np.int64))  # MAX_PARTS at most
    coded = encode(rows, vocab_path, end_id, bits, text, {
        "bucket": lambda batch: bucket(shared.value, batch.column(1), batch.column(2))}, "bucket int")
    dealt = coded.repartition("bucket").sortWithinPartitions(*order)
    files, _ = written(dealt.select("bucket", "key", "ids").mapInArrow(light(run), MANIFEST), "token-manifest")
    sizes = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).astype(int).tolist()
    base = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part int, base long")
    return files.join(F.broadcast(base), "part").select(  # one row a range
        "part", "file", "path", (F.col("base") + F.col("part_start")).alias("start"), "n_docs", "n_ids")


def read_ids(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids of every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _at(row["path"])
                with store.open_input_file(path) as file:
                    tokens = TokenFile(file)
                    keys, starts = tokens.documents()
                    first = 0
                    while first < len(keys):
                        last = max(first + 1, int(np.searchsorted(starts, starts[first] + READ_IDS, "right")) - 1)
                        places = starts[first:last + 1]
                        ids = tokens.ids(int(places[0]), int(places[-1])).astype("<u4")
                        ends = pa.array((places - places[0]) * 4, pa.int64())
                        cells = pa.LargeBinaryArray.from_buffers(
                            pa.large_binary(), last - first, [None, ends.buffers()[1], pa.py_buffer(ids)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[first:last], pa.int64()), pa.array(places[:-1] + row["start"], pa.int64()),
                             pa.array(np.diff(places), pa.int64()), cells.cast(pa.binary())],
                            [key, "start", "n_tokens", "ids"])
                        first = last

    slots = manifest.sparkSession.sparkContext.defaultParallelism
    width = max(4 * slots, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path", "start").repartition(width).mapInArrow(
        run, f"`{key}` long, start long, n_tokens long, ids binary")


def ids_at(manifest: DataFrame, positions: DataFrame) -> DataFrame:
    """position, id: single ids of the whole sequence, each read at its own place.

    ``positions``: one bigint column ``position``; positions outside the sequence have no row.
    """
    spark = manifest.sparkSession
    files = manifest.where("n_ids > 0")
    starts = np.array(sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.min("start")).select(
        "min(start)", "part").collect()), np.int64).reshape(-1, 2)
    shared = spark.sparkContext.broadcast(starts)  # one row a partition of files

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, part = shared.value[:, 0], shared.value[:, 1]
        for batch in batches:
            at = batch.column(0).drop_null().to_numpy()
            at = at[at >= 0] if len(begin) else at[:0]
            place = np.searchsorted(begin, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(part[place].astype(np.int32))], ["position", "part"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opened: dict[str, list[tuple[int, int]]] = {}
            for path, start, position in zip(*(c.to_pylist() for c in batch.columns)):
                opened.setdefault(path, []).append((position, position - start))
            for path, wanted in opened.items():
                store, place = _at(path)
                with store.open_input_file(place) as file:
                    tokens = TokenFile(file)
                    yield pa.RecordBatch.from_pydict({
                        "position": pa.array([p for p, _ in wanted], pa.int64()),
                        "id": pa.array([tokens.id(i) for _, i in wanted], pa.int64())})

    found = positions.select(F.col("position").cast("long")).mapInArrow(locate, "position long, part int").join(
        files, "part").where("position >= start and position < start + n_ids")
    return found.select("path", "start", "position").mapInArrow(read, "position long, id long")


def digests(docs: DataFrame, vocab_path: str, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids of every document, read back from its files."""
    return read_ids(write_ids(docs, vocab_path, end_id)).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
