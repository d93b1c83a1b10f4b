"""Language identification by nearest centroids.

A text's vector holds the counts of its lower-cased byte 2- and 3-grams
(runs of ASCII characters other than letters are one space), hashed to ``DIMS`` places, as (1 + ln count) times the inverse document
frequency, at length 1. Each language is described by up to ``CLUSTERS``
centroids from spherical k-means, and a text gets the language of the
centroid with the largest cosine. A text is rejected if it has no letter,
or if its cosine distance is too large: below ``margin`` times the lowest
cosine that the fitting texts of that language have with their own centroid.

Fitting uses a documented bound: at most ``per_language`` labelled texts of
each language, those with the smallest hash of their id. Texts that are
rejected for want of a letter are not fitted on. Counting, document
frequencies and the clustering of each language run as Spark jobs; the
driver holds one vector of document frequencies and the centroids.

Defined results: null text, or text without a letter: ``und``, score 0,
rejected; no labelled row at all: every text ``und``; equal cosines: the
language first in alphabetical order; rows with a null id are classified
but never fitted on; repeated rows are each classified, and the smallest text
of a repeated id and language is fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.graph import drop_written, light, written

DIMS = 1 << 13
CLUSTERS = 4
PER_LANGUAGE = 400
MARGIN = 0.25
SPREAD = 1 << 40
PIECE_CHARS = 1 << 20
#: ASCII characters other than letters count as one space a run.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Hashed counts of a whole text's byte 2- and 3-grams, piece by piece."""
    total = np.zeros(DIMS, np.int64)
    tail = b" "
    for at in range(0, len(text), PIECE_CHARS):
        b = np.frombuffer(tail + text[at:at + PIECE_CHARS].lower().encode().translate(LETTERS), np.uint8)
        gap = b == 32
        b = b[np.concatenate([[True], ~(gap[1:] & gap[:-1])])].astype(np.uint32)
        if len(b) >= 2:
            two = (b[:-1] << 8) | b[1:]
            # n-grams that lie wholly in the tail were counted with the piece before
            for gram, skip in ((two, len(tail) - 1),
                               (((two[:-1] << 8) | b[2:]) + np.uint32(1 << 24), max(len(tail) - 2, 0))):
                place = (gram[skip:] * np.uint32(2654435761)) >> np.uint32(32 - 13)
                total += np.bincount(place, minlength=DIMS)
        tail = b[-2:].astype(np.uint8).tobytes()
    return total


def _unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Languages of the centroids, the centroids, idf and each one's lowest cosine kept."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        pred, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.langs else []
        for at in range(0, len(rows), 256):
            part = rows[at:at + 256]
            cos = _unit(np.stack([counts(texts[i]) for i in part]), self.idf) @ self.centroids.T
            best = cos.argmax(axis=1)
            for i, k, c in zip(part, best.tolist(), cos.max(axis=1).tolist()):
                pred[i], score[i] = self.langs[k], min(max(c, 0.0), 1.0)
                rejected[i] = c < self.floors[k]
        return pred, score, rejected


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from a farthest-first start: centroids, cosines."""
    mean = vectors.mean(axis=0)
    chosen = [int((vectors @ mean).argmax())]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int((vectors @ vectors[chosen].T).max(axis=1).argmin()))
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[own == j].sum(axis=0) if (own == j).any() else centroids[j]
                         for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids, (vectors @ centroids.T).max(axis=1)


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fold that is never fitted on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, margin: float = MARGIN) -> Model:
    """Centroids from ``doc_id, text, lang`` rows; null ids and labels and texts without a letter are left out."""
    spark = labelled.sparkSession
    rows = labelled.where("doc_id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    hashed = rows.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).alias("h")).distinct()
    # Hashes are spread evenly, so the smallest per_language of a language lie
    # below this share of them; only rows that do meet in the ranking.
    share = hashed.groupBy("lang").count().select(
        "lang", (F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("count")) * SPREAD).alias("below"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = hashed.join(F.broadcast(share), "lang").where("h < below").withColumn("n", F.row_number().over(order)).where(
        F.col("n") <= per_language).select("doc_id", "lang")
    # One row, and at most per_language ids, for each language: broadcasts of a
    # known bound, which spare ids and texts a shuffle by language.
    picked = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").groupBy(
        "doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not LETTER.search(text):  # a letter of the JVM's Unicode version only
                    continue
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang]), "tf": pa.array([counts(text).astype("<f4").tobytes()])})

    sample, path = written(picked.mapInArrow(light(count), "lang string, tf binary"), "language-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            for tf in batch.column(1).to_pylist():
                n += 1
                df += np.frombuffer(tf, "<f4") > 0
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "df": pa.array([df.tobytes()])})

    parts = sample.coalesce(16).mapInArrow(frequencies, "n long, df binary").collect()
    n = sum(p.n for p in parts)
    df = sum((np.frombuffer(p.df, np.int64) for p in parts), np.zeros(DIMS, np.int64))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def centroids(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        vectors = _unit(np.stack([np.frombuffer(t, "<f4") for t in group["tf"]]), idf)
        found, cos = cluster(vectors, CLUSTERS)
        return pd.DataFrame({"lang": key[0], "floor": float(cos.min()),
                             "centroid": [c.astype("<f4").tobytes() for c in found]})

    found = sorted(sample.groupBy("lang").applyInPandas(
        centroids, "lang string, floor double, centroid binary").collect(),
        key=lambda r: (r.lang, bytes(r.centroid)))
    drop_written(spark, path)
    return Model([r.lang for r in found],
                 np.stack([np.frombuffer(r.centroid, "<f4") for r in found]) if found
                 else np.zeros((0, DIMS), np.float32),
                 idf, margin * np.array([r.floor for r in found]))


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, rejected = shared.value.predict(batch.column(kept.index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(rejected, pa.bool_())], [*kept, *new])

    rows = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(light(run), f"{schema}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, fitted outside the held-out fold."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return classify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")),
                    model).drop("text")


def recognised(docs: DataFrame) -> DataFrame:
    """All columns of the documents that are not rejected."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("text", F.struct(*docs.drop("text").columns).alias("row"))
    return classify(rows, model).where("not rejected").select(
        *(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
