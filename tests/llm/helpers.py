"""Small rows and brute-force versions for the operator tests."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def documents(spark, rows):
    """Documents with an extra column whose name an operator uses itself."""
    return spark.createDataFrame(
        [(i, t, lang, "src", None if t is None else len(t), 0.5) for i, t, lang in rows], DOCS)


def prose(seed: int, n: int, words="the of alpha beta gamma delta river stone cloud window") -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words.split()) + str(r.randrange(50)) for _ in range(n))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


def tokenizer_path(name: str) -> str:
    return pytest.importorskip("public_tokenizers").path(name)
