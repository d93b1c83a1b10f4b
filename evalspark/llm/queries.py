"""The registered queries of this folder and their DuckDB SQL.

Each query applies one operator with production parameters to its whole
table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import (
    bpe, centroids, chat, decontam, hnsw, lang_id, simhash, spelling, suffix_dedup, token_count, token_ids, url_filter, warc)
from evalspark.llm.graph import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded digests of every whole text."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written as archives and read back in byte ranges."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rendered text per conversation that no other one continues."""
    return chat.chat_texts(_table(spark, sf_dir, "conversations"))


#: The contract's rules: host, path, action.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url under the rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(_table(spark, sf_dir, "pages"), rules)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text: 4-word shingles, 4 bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, seed=42, radius=4)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every whole text under the piece vocabulary."""
    return token_count.token_counts(_table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("piece_bpe_32k.model"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the similarity."""
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every whole text keeps after the 50-byte strings of smaller ids go."""
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the other folds."""
    return lang_id.identify(_table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "lang_pred", "score")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.9 or more."""
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.9)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every 64-component vector after five rounds from 40 seeds."""
    return centroids.digests(_table(spark, sf_dir, "embeddings"))


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, read back from the files."""
    return token_ids.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the corpus that occurs twice or more."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_chat": op3_chat,
    "op4_url_filter": op4_url_filter,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_centroids": op11_centroids,
    "op12_token_ids": op12_token_ids,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op3_chat": chat.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op10_embedding_dedup": hnsw.ORACLE,
    "op11_centroids": centroids.ORACLE,
}
