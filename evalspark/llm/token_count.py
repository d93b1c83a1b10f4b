"""Token counts of whole texts, from Arrow functions that return lengths only.

A sentencepiece model whose pieces hold the space mark only at their
start never joins what stands before a space with the space. A text may
therefore be cut before a single space between two other characters: the
piece's own leading space is restored by the model's dummy prefix. Long
texts are cut there, and the pieces are encoded in batches of about
``BATCH_BYTES``, so neither a long text nor a run of long texts sets the
size of a call. ``tests/llm`` holds the cuts against whole-text encoding.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a text
without a safe boundary is encoded in one piece; repeated rows are each
counted; other columns pass through, and those named like an output
column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.graph import light

#: Characters after which a long text is cut at the next safe boundary,
#: and bytes (UTF-8) handed to the library in one call.
PIECE_CHARS = 4096
BATCH_BYTES = 1 << 20
#: A single space between characters that are neither space nor space mark.
BOUNDARY = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        spec = pb.ModelProto.FromString(f.read())
    norm = spec.normalizer_spec
    splits = (norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix
              and not norm.remove_extra_whitespaces and norm.escape_whitespaces
              and not spec.trainer_spec.treat_whitespace_as_suffix
              and not any("▁" in p.piece.lstrip("▁") or p.type == p.USER_DEFINED
                          for p in spec.pieces))
    return sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString()), splits


def pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """A text cut at safe boundaries into pieces of a little over ``size``."""
    if len(text) <= size:
        return [text] if text else []
    out, at = [], 0
    while len(text) - at > size:
        cut = BOUNDARY.search(text, at + size)
        if cut is None:
            break
        out.append(text[at:cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def _lengths(model, splits: bool, texts: list[str | None]) -> list[int]:
    counts = [0] * len(texts)
    owner: list[int] = []
    batch: list[str] = []
    held = 0

    def flush() -> None:
        for i, ids in zip(owner, model.encode(batch, num_threads=1)):
            counts[i] += len(ids)

    for i, text in enumerate(texts):
        for piece in (pieces(text) if splits else [text]) if text else ():
            owner.append(i)
            batch.append(piece)
            held += len(piece) if piece.isascii() else len(piece.encode())
            if held >= BATCH_BYTES:
                flush()
                owner.clear(), batch.clear()
                held = 0
    flush()
    return counts


def token_counts(df: DataFrame, model_path: str, text: str = "text", limit: int = 4096,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_bytes, n_tokens and over_limit of each whole text."""
    new = [T.StructField("n_tokens", T.LongType())]
    kept = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    rows = df.select(*kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                     F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, splits = _model(model_path)
        for batch in batches:
            counts = _lengths(model, splits, batch.column(batch.num_columns - 1).to_pylist())
            cols = dict(zip(batch.schema.names[:-1], batch.columns[:-1]))
            yield pa.RecordBatch.from_pydict(cols | {"n_tokens": pa.array(counts, pa.int64())})

    schema = T.StructType(rows.schema.fields[:-1] + new)
    return rows.mapInArrow(light(run), schema).withColumn("over_limit", F.col("n_tokens") > limit)
