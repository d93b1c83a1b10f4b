"""Byte-level BPE encoding and decoding.

Encoding goes word by word, where a word is a match of the tokenizer's
split pattern. The distinct new words of a chunk of texts form a
trie, and one depth-first walk gives every node the last token of its
prefix's encoding. That token is the only vocabulary suffix that stands
next to the encoding of what precedes it without a merge joining the two,
so a node needs only the states of its ancestors: a shared prefix is
encoded once, however many words begin with it. A word's ids are read
backwards from its node.

Defined results: a null text counts as empty (no ids, decoded to ''); a
special token's string inside a text is that token; any other column
passes through, and a column named like an output column is replaced.
Every row is encoded on its own, so repeated rows, ties and row order do
not matter. Memory per worker is one Arrow batch, the vocabulary and
caches of about ``CACHE_WORDS`` entries, which are emptied when full.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.graph import light

#: Fixed value: the split pattern of the byte-level vocabularies, with white
#: space as Unicode defines it.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

#: Distinct words remembered per worker; when there are more, the cache is
#: emptied before the next chunk.
CACHE_WORDS = 200_000
#: Bytes of text (or of ids) handled together: their new words form one trie.
CHUNK_BYTES = 1 << 22


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable ones stand for
    themselves, the others for the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in shown)
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A byte-level BPE vocabulary with its merges."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]],
                 special: dict[str, int]):
        self.ids = vocab
        self.special = special
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *((s.encode(), i) for s, i in special.items())]:
            self.bytes[i] = token
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.longest = max(map(len, vocab))
        self.special_split = re.compile(
            "(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.made = {new: (r, a, b) for (a, b), (r, new) in reversed(self.rank.items())}
        self.spines: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cache_words = CACHE_WORDS

    @classmethod
    def load(cls, path: str) -> "Bpe":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_alphabet()
        raw = lambda s: bytes(byte[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        model = spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls({raw(t): i for t, i in model["vocab"].items() if t not in special},
                   [(raw(a), raw(b)) for a, b in pairs], special)

    def merge(self, text: bytes) -> list[int]:
        """Ids of a short byte string by applying the merges in rank order."""
        ids = [self.ids[text[i:i + 1]] for i in range(len(text))]
        while len(ids) > 1:
            best = min((self.rank.get(p, (len(self.rank), -1)) for p in zip(ids, ids[1:])))
            if best[1] < 0:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.rank.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """What stands at the token's right (0) or left (1) edge while it is
        merged: (part, rank that made it, rank that takes it into the next)."""
        known = self.spines.get((token, side))
        if known is None:
            known, part, taken = [], token, float("inf")
            while part in self.made:
                rank, left, right = self.made[part]
                known.append((part, rank, taken))
                part, taken = (left if side else right), rank
            known.append((part, -1, taken))
            self.spines[token, side] = known
        return known

    def stands_apart(self, left: int, right: int) -> bool:
        """Whether no merge ever joins two neighbouring tokens.

        A merge of rank r joins part a of the left token with part b of the
        right one if it comes up while both stand at the border: after the
        merges that made them and before those that take them. Among equal
        ranks the merge further left comes first.
        """
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > self.cache_words:
                self.apart.clear()
            known, rank = True, self.rank
            for a, made_a, taken_a in self.spine(left, 0):
                for b, made_b, taken_b in self.spine(right, 1):
                    joined = rank.get((a, b))
                    if joined is not None:
                        when = max(joined[0], made_a, made_b)
                        if when < taken_a and when <= taken_b:
                            known = False
            self.apart[key] = known
        return known

    def stands_alone(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this one token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.bytes[token]) == [token]
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of each distinct non-empty word by a depth-first walk of their trie.

        Sorted, the words stand in the trie's depth-first order: the common
        prefix with the word before is the path to the branching node, whose
        states hold, and only the nodes below it are new. ``token`` and
        ``before`` are the states along the current path: the last token of
        the prefix of each depth, and the depth at which it starts.
        """
        ids, longest = self.ids, self.longest
        apart, alone = self.apart, self.stands_alone
        out: dict[bytes, list[int]] = {}
        token, before = [-1], [0]
        path = b""
        for word in sorted(words):
            depth, shared = 0, min(len(path), len(word))
            while depth < shared and path[depth] == word[depth]:
                depth += 1
            del token[depth + 1:], before[depth + 1:]
            path = word
            for depth in range(depth + 1, len(word) + 1):
                # One start fits, so any order will do: first the one that
                # makes the parent's last token longer.
                guess = before[-1]
                for start in (guess, *range(depth - 1, guess, -1),
                              *range(guess - 1, max(depth - longest, 0) - 1, -1)):
                    t = ids.get(word[start:depth])
                    if t is None:
                        continue
                    if start:
                        last = token[start]
                        fits = apart.get((last, t))
                        if fits is None:
                            fits = self.stands_apart(last, t)
                    else:
                        fits = alone(t)
                    if fits:
                        token.append(t)
                        before.append(start)
                        break
            back, at = [], len(word)
            while at:
                back.append(token[at])
                at = before[at]
            out[word] = back[::-1]
        return out

    def words(self, text: str) -> list[str]:
        """Words of a text; a special token's string is a word of its own."""
        find = SPLIT.findall
        parts = self.special_split.split(text) if self.special else [text]
        if len(parts) == 1:
            return find(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else find(part))]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each text."""
        self._learn(texts)
        known = self.cache.__getitem__
        return [b"".join(map(known, self.words(t))) if t else b"" for t in texts]

    def _learn(self, texts: list[str | None]) -> None:
        """Encodes the words of the texts that the cache does not hold."""
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        known = self.cache
        new = {w for text in texts if text for w in self.words(text) if w not in known}
        ids = self.encode_words(w.encode() for w in new if w not in self.special)
        for w in new:
            coded = [self.special[w]] if w in self.special else ids[w.encode()]
            self.cache[w] = pack(f"<{len(coded)}I", *coded)

    def decode(self, packed: bytes | None) -> str:
        """Text of packed ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(path: str) -> Bpe:
    return Bpe.load(path)


def _chunks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches in which a string or binary column has about ``size`` bytes."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        begin = held = 0
        for i, n in enumerate(lengths):
            held += n or 0
            if held >= size:
                yield batch.slice(begin, i + 1 - begin)
                begin, held = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _replace(batch: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple[str, ...]) -> pa.RecordBatch:
    cols = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in drop and n not in new}
    return pa.RecordBatch.from_pydict(cols | new)


def _schema(df: DataFrame, new: list[T.StructField], drop: tuple[str, ...]) -> T.StructType:
    names = {f.name for f in new} | set(drop)
    return T.StructType([f for f in df.schema.fields if f.name not in names] + new)


def encode(df: DataFrame, vocab_path: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``ids`` (packed little-endian unsigned 32-bit) and ``n_tokens``."""
    drop = () if keep_text else (text,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocab_path)
        for batch in _chunks(batches, text, CHUNK_BYTES):
            packed = bpe.encode_batch(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield _replace(batch, {"ids": pa.array(packed, pa.binary()),
                                   "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64())}, drop)

    new = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    return df.mapInArrow(light(run), _schema(df, new, drop))


def decode(df: DataFrame, vocab_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds ``into``: the text of the packed ids, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocab_path)
        for batch in _chunks(batches, ids, CHUNK_BYTES):
            packed = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            yield _replace(batch, {into: pa.array([bpe.decode(p) for p in packed], pa.string())}, ())

    return df.mapInArrow(light(run), _schema(df, [T.StructField(into, T.StringType())], ()))


def round_trip(docs: DataFrame, vocab_path: str, key: str = "doc_id", cache_words: int = CACHE_WORDS,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """key, ids, n_tokens, decoded: each whole text encoded, then decoded from
    its ids, in one pass, so that a task needs one worker and one vocabulary.
    A smaller cache takes less memory and more time, smaller chunks less memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocab_path)
        bpe.cache_words = cache_words
        for batch in _chunks(batches, "text", chunk_bytes):
            packed = bpe.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary()),
                 pa.array([len(p) // 4 for p in packed], pa.int64()),
                 pa.array([bpe.decode(p) for p in packed], pa.string())], [key, "ids", "n_tokens", "decoded"])

    rows = docs.select(key, "text")
    return rows.mapInArrow(light(run), _schema(rows, [
        T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded", T.StringType())], ("text",)))


def digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    return round_trip(docs, vocab_path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
