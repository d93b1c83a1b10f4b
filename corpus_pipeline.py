"""Corpus pipeline: from raw documents to token ids.

Each stage works on all documents that the stage before it kept. Every stage
but the last returns the columns of ``documents``; between stages the rows
are written as Parquet in the shared folder and read again, so a lost
executor never costs an earlier stage.

language    documents without a recognised language go
near        one document of each SimHash component stays
repeats     bytes of 50-byte strings of smaller doc_ids are cut out of texts
benchmark   documents that hold a benchmark item go
tokens      ids of each whole text, and the text decoded from them as digest
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import bpe, decontam, lang_id, simhash, suffix_dedup
from evalspark.llm.graph import clear, made, small_batches, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lang_id.recognised(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, width=4, seed=42, radius=4)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit), decoded_sha256."""
    small_batches(spark)
    # beside what earlier stages leave in an executor a small cache and small chunks are the better ones
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_words=100_000,
                          chunk_bytes=1 << 20).select(
        "doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near", near), ("repeats", repeats), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL expresses none of the first four stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    others = made()
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, {*others, path})  # what only this stage needed
    return docs
