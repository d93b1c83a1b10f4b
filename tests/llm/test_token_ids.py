"""Token ids in directly addressable codes: against the library, round trips, random access."""

import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import token_ids as C
from tests.llm.helpers import documents, prose, rows_of, tokenizer_path

VOCAB = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def encoder():
    return C.Encoder(tokenizer_path(VOCAB))


def whole(encoder, text):
    return encoder.library.encode(text or "", add_special_tokens=False).ids


def unpacked(data):
    return np.frombuffer(data, "<u4").tolist()


ODD = ["", " ", "\n\n", "a  b\t c\r\nd", "don't we'll 12,5", "<|endoftext|>x <|startoftext|> <|endof text|>", "é ́e ́",
       " a  b\u0085c d\x1ce\x0bf", "İǅΣς ﬁ \U0001f600\U0001f468‍\U0001f469", "ᄀ ᅡ", "각",
       "x" * 5000, "ß### ßß, Straße ÀÉÖØÞ×÷µª²½ naïve-Über!!", "a<|endoftext|>b<|", "don'tx 'Sx I'LL'VE", "\x7f \x00a \xa0\xadb",
       "中文 กำ", "'s 's'S", "a" + "́" * 40]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_as_the_library(encoder, text):
    assert unpacked(encoder.encode(text)) == whole(encoder, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'aAsStT19.,́Àİ가<|>"), st.characters(codec="utf-8")),
                        max_size=40), max_size=6))
def test_texts_as_the_library(texts):
    encoder = C._encoder(tokenizer_path(VOCAB), 32)
    assert [unpacked(encoder.encode(t)) for t in texts] == [whole(encoder, t) for t in texts]


def test_long_texts_are_cut_and_the_cache_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_CHARS", 64)
    monkeypatch.setattr(C, "CACHE_PIECES", 20)
    texts = [prose(i, 300) + "\n" + "y" * 200 + " " + prose(i, 5) for i in range(5)] + [None, "z" * 500]
    assert [unpacked(encoder.encode(t)) for t in texts] == [whole(encoder, t) for t in texts]


def opened(keys, counts, ids, widths=C.WIDTHS):
    return C.TokenFile(pa.PythonFile(io.BytesIO(b"".join(C.pack(keys, np.array(counts, np.int64), ids, widths))), "r"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 65535), st.integers(0, 2 ** 32 - 1)), max_size=1500),
       st.data())
def test_any_id_and_any_run(values, data):
    ids = np.array(values, "<u4")
    file = opened([1], [len(ids)], ids)
    assert file.ids(0, len(ids)).tolist() == values
    if values:
        a = data.draw(st.integers(0, len(values)))
        b = data.draw(st.integers(a, len(values)))
        assert file.ids(a, b).tolist() == values[a:b]
        i = data.draw(st.integers(0, len(values) - 1))
        assert file.id(i) == values[i]
    with pytest.raises(IndexError):
        file.id(len(values))


@pytest.mark.parametrize("widths", [(32,), (8, 8, 8, 8), (16, 16)])
def test_other_widths(widths):
    ids = np.random.default_rng(1).integers(0, 2 ** 32, 2000).astype("<u4") >> np.random.default_rng(2).integers(0, 32, 2000).astype("<u4")
    file = opened([None, 5], [1200, 800], ids, widths)
    assert file.documents()[0] == [None, 5]
    assert [file.id(i) for i in range(0, 2000, 37)] == ids[::37].tolist()
    with pytest.raises(ValueError):
        C.levels(np.array([1 << 20]), (8, 8))


def rows(spark):
    texts = [(7, prose(1, 400), "en"), (2, None, "en"), (5, "", None), (None, "no id", "en"), (9, "end " * 3000, "en"),
             (5, "tie one", "en"), (5, "tie two", "en"), (5, "tie two", "en"), (11, "Été <|endoftext|>", "fr")]
    texts += [(100 + i, prose(i, i % 30), "en") for i in range(120)]
    return documents(spark, texts).repartition(5).withColumnRenamed("score", "ids")


def test_files_hold_the_documents_in_order(spark, encoder, monkeypatch):
    monkeypatch.setattr(C, "FILE_IDS", 500)
    monkeypatch.setattr(C, "READ_IDS", 200)
    docs = rows(spark)
    manifest = C.write_ids(docs, tokenizer_path(VOCAB), 1).cache()
    assert manifest.count() > 3
    found = sorted(C.read_ids(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.n_tokens for r in found])])[:-1].tolist()
    assert [(r.doc_id is not None, r.doc_id) for r in found] == sorted(
        (r.doc_id is not None, r.doc_id) for r in found)
    expected = sorted((str(r.doc_id), whole(encoder, r.text) + [1]) for r in docs.collect())
    assert sorted((str(r.doc_id), unpacked(r.ids)) for r in found) == expected

    ids = [i for r in found for i in unpacked(r.ids)]
    asked = [*range(0, len(ids), 7), len(ids) - 1, len(ids), -1, None, 3, 3]
    at = C.ids_at(manifest, spark.createDataFrame([(p,) for p in asked], "position long"))
    assert rows_of(at) == rows_of(spark.createDataFrame(
        [(p, ids[p]) for p in asked if p is not None and 0 <= p < len(ids)], "position long, id long"))


def test_digests(spark, encoder):
    docs = rows(spark)
    found = rows_of(C.digests(docs, tokenizer_path(VOCAB)).select("doc_id", "n_tokens", "ids_crc32"))
    coded = [(r.doc_id, whole(encoder, r.text) + [1]) for r in docs.collect()]
    assert found == rows_of(spark.createDataFrame(
        [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in coded], "a long, b long, c long"))


def test_a_key_with_most_documents_fills_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(C, "PART_BYTES", 2000)
    texts = [(7, prose(i, 40), "en") for i in range(200)] + [(i, prose(i, 40), "en") for i in range(0, 20)]
    texts += [(None, prose(i, 40), "en") for i in range(10)]
    docs = documents(spark, texts).repartition(4)
    manifest = C.write_ids(docs, tokenizer_path(VOCAB), 1).cache()
    assert manifest.select("part").distinct().count() > 10
    found = sorted(C.read_ids(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None] * 10 + sorted(i for i, *_ in texts if i is not None)
    again = sorted(C.read_ids(C.write_ids(docs.repartition(3), tokenizer_path(VOCAB), 1)).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in found] == [tuple(r) for r in again]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert C.digests(docs, tokenizer_path(VOCAB)).count() == 0
    manifest = C.write_ids(docs, tokenizer_path(VOCAB), 1)
    assert C.ids_at(manifest, spark.createDataFrame([(0,)], "position long")).count() == 0
