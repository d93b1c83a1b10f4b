"""BPE, token counts, SimHash, suffix-array dedup, language ID."""

import hashlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from evalspark.llm import bpe, lang_id, simhash, suffix_dedup, token_count
from evalspark.llm.graph import components
from tests.llm.helpers import documents, prose, rows_of, tokenizer_path

ODD_TEXTS = [None, "", " ", "\n\n  x", "<|endoftext|> a<|endoftext|>", "naïve café 東京 12 's 've\u2003\u2003y",
             "\x00\x1c\x85z", "a" * 3000, "word " * 4000, "  two  spaces ", "▁mark ▁ x", "\U0001f600 e\u0301"]


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe.load(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_bpe_encodes_as_the_library(coder, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = coder.encode_batch(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [coder.decode(g) for g in got] == texts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aeinst", min_size=1, max_size=12), min_size=1, max_size=10))
def test_trie_walk_is_the_merge_loop(coder, words):
    raw = {w.encode() for w in words}
    assert coder.encode_words(raw) == {w: coder.merge(w) for w in raw}


def test_bpe_query_on_odd_texts(spark, library):
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(ODD_TEXTS)] + [(0, None, "en"), (None, "x", None)])
    got = {(r.doc_id, r.decoded_sha256): (r.n_tokens, r.ids_sha256)
           for r in bpe.digests(docs, tokenizer_path("byte_bpe_50k.json")).collect()}
    for i, t in [*enumerate(ODD_TEXTS), (None, "x")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        key = (i, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert got[key] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert bpe.digests(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0
    two = bpe.decode(bpe.encode(docs, tokenizer_path("byte_bpe_50k.json")), tokenizer_path("byte_bpe_50k.json"))
    assert two.where("coalesce(text, '') <> decoded").count() == 0
    carried = bpe.encode(docs.withColumn("ids", F.lit(1)), tokenizer_path("byte_bpe_50k.json"))
    assert carried.schema["ids"].dataType.simpleString() == "binary" and carried.count() == docs.count()


def test_bpe_chunk_size_changes_no_row(spark):
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(ODD_TEXTS * 3)]).coalesce(1)
    one, some, all_ = (rows_of(bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.json"), cache_words=20, chunk_bytes=n))
                       for n in (1, 5000, 1 << 22))
    assert one == some == all_ and len(one) == 3 * len(ODD_TEXTS)


def test_pipeline_tokens_take_small_chunks(spark, monkeypatch):
    asked = {}
    real = bpe.round_trip
    monkeypatch.setattr(bpe, "round_trip", lambda *a, **k: asked.update(k) or real(*a, **k))
    corpus_pipeline.tokens(spark, documents(spark, [(1, "a b", "en")]), "")
    assert asked["chunk_bytes"] <= 1 << 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "▁", "é", "x y", "東", ". "]), max_size=60))
def test_cut_texts_count_as_whole(parts):
    model, splits = token_count._model(tokenizer_path("piece_bpe_32k.model"))
    text = "".join(parts)
    assert splits
    assert sum(len(model.encode(p)) for p in token_count.pieces(text, 5)) == len(model.encode(text))


def test_token_counts_on_odd_texts(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    model, _ = token_count._model(path)
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(ODD_TEXTS)] + [(1, "", "en"), (None, "a b", None)])
    got = token_count.token_counts(docs.withColumn("n_tokens", F.lit("x")), path, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100)
            for i, t in [*enumerate(ODD_TEXTS), (1, ""), (None, "a b")]]
    assert rows_of(got) == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert token_count.token_counts(docs.limit(0), path).count() == 0


def plain_fingerprint(text: str | None) -> int:
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    parts = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "One", "One two THREE", "A b\u00a0c D e F a b c d e f", prose(1, 90)])
def test_fingerprint(monkeypatch, text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE_BYTES", 16)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_comparison_is_popcount(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 1 << 63, 12, dtype=np.uint64)[rng.integers(0, 12, 400)]
    for _ in range(5):
        prints ^= np.where(rng.random(400) < .6, np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64), np.uint64(0))
    group = np.sort(rng.integers(0, 9, 400))
    got = {(int(a), int(b)) for i, j in simhash.near(prints, group, radius) for a, b in zip(i, j)}
    assert got == {(a, b) for a, b in combinations(range(400), 2) if group[a] == group[b]
                   and int(prints[a] ^ prints[b]).bit_count() <= radius}


def test_tables_let_every_near_pair_meet():
    for n in (10, 10**8, 10**10, 10**13):
        masks = simhash.tables(n, 4)
        for flips in ((0, 20, 40, 63), (12, 13, 25, 26), (1, 2, 3, 4)):
            assert any(not any(m >> f & 1 for f in flips) for m in masks)


def test_simhash_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3)  # the driver's plan splits buckets into blocks
    base = prose(3, 400)
    texts = [(i, f"{base} tail{i}" if i % 3 else prose(i, 40), "en") for i in range(30)]
    texts += [(40, None, "en"), (41, "", None), (42, " \n", "en"), (7, texts[7][1], "en"), (None, "lonely text", "en")]
    texts += [(None, texts[3][1], "en")]
    docs = documents(spark, texts).withColumnsRenamed({"score": "fp"}).withColumn("component_id", F.lit("x"))
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    prints = {i: plain_fingerprint(t) for i, t, _ in texts if i is not None}
    label = {i: i for i in prints}
    for _ in prints:
        for a, b in combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                label[a] = label[b] = min(label[a], label[b])
    of_print = {p: label[i] for i, p in prints.items()}
    want = [(i, f"{plain_fingerprint(t):016x}", of_print.get(plain_fingerprint(t))) for i, t, _ in texts]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    # of the rows without an id only the one that is like no other stays
    assert sorted(((r.doc_id, r.text) for r in kept.collect() if r.doc_id is None)) == [(None, "lonely text")]
    assert {r.doc_id for r in kept.collect()} == {None, *label.values()}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_rows_without_an_id_link_others(spark):
    rows = [(5, 0x0), (None, 0xF), (3, 0xFF), (None, 0xFFFF0000), (None, 0xFFFF0001), (8, -1), (9, -8), (None, -1)]
    got = dict(map(tuple, simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long"), 4).collect()))
    assert got == {0x0: 3, 0xF: 3, 0xFF: 3, 0xFFFF0000: None, 0xFFFF0001: None, -1: 8, -8: 8}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(1, None), (70, 70)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {k: 5 for k in range(5, 40)}


def plain_repeats(rows, width=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1) if i is not None else ():
            first[b[p:p + width]] = min(i, first.get(b[p:p + width], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, np.int8)
        for p in range(len(b) - width + 1) if i is not None else ():
            if first[b[p:p + width]] < i:
                gone[p + 1:p + 1 + width] = 1
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        yield (i, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("hot", [1, 50_000])
def test_suffix_dedup_is_brute_force(spark, hot):
    common = prose(9, 30)
    rows = [(i, f"{prose(i, 20)} {common[i % 7:]}é{prose(i % 4, 25)}", "en") for i in range(24)]
    rows += [(30, None, "en"), (31, "", "en"), (32, "z" * 700, "en"), (33, "z" * 300 + "q", "en"), (None, "z" * 99, "en"),
             (33, "z" * 120, "en"), (34, common[:49], "en"), (35, "é" * 60, "en"), (36, "x" + "é" * 60, "en")]
    docs = documents(spark, rows).repartition(5)
    want = list(plain_repeats([r[:2] for r in rows]))
    got = [tuple(r) for r in suffix_dedup.digests(docs, pack_bytes=1500, hot_runs=hot).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 1000


def test_suffix_dedup_keeps_columns(spark):
    twice = prose(2, 40)
    docs = documents(spark, [(1, twice, "en"), (2, twice + "é" * 40, "fr"), (3, None, None)]).withColumn("spans", F.lit(7))
    got = {r.doc_id: r for r in suffix_dedup.deduplicated(docs).collect()}
    assert suffix_dedup.deduplicated(docs).columns == docs.columns
    assert (got[1].text, got[2].text, got[3].text) == (twice, "é" * 40, "")
    assert (got[2].n_chars, got[2].lang, got[2].spans, got[2].score) == (40, "fr", 7, 0.5)
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_language_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Élan  vital 12, l'été. " * 9
    whole = lang_id.counts(text)
    monkeypatch.setattr(lang_id, "PIECE_CHARS", 7)
    assert (lang_id.counts(text) == whole).all()


def test_language_id(spark):
    words = {"aa": "kala mina sato rupi", "bb": "thorn wedge blick frust"}
    rows = [(i, prose(i, 30, words["ab"[i % 2] * 2]), "ab"[i % 2] * 2) for i in range(90)]
    rows += [(200, None, "aa"), (201, "12 !? 3", "aa"), (202, "", None), (None, "kala mina kala", "bb"), (3, rows[3][1], "bb")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in lang_id.identify(docs).collect()}
    assert all(got[i].lang_pred == "ab"[i % 2] * 2 for i in range(90))
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (200, 201, 202)] == [("und", 0.0, True)] * 3
    assert got[None].lang_pred == "aa" and not got[None].held_out
    kept = lang_id.recognised(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept) == rows_of(docs.where("doc_id is null or doc_id < 100"))
    assert lang_id.identify(docs.limit(0)).count() == 0
    unlabelled = lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.select("lang_pred").collect()} == {"und"}


def test_language_rejection_survives_odd_labelled_texts(spark):
    words = {"aa": "kala mina sato rupi", "bb": "thorn wedge blick frust"}
    rows = [(i, prose(i, 30, words["ab"[i % 2] * 2]), "ab"[i % 2] * 2) for i in range(90)]
    unlearned = " ".join(chr(0x10D0 + i % 33) * (2 + i % 5) for i in range(400))
    odd = [(200, "", "aa"), (201, "12 !? 3", "bb"), (202, "", "cc")]
    docs = documents(spark, rows + odd)
    model = lang_id.fit(docs)
    assert set(model.langs) == {"aa", "bb"} and (model.floors > 0).all()
    assert (np.linalg.norm(model.centroids, axis=1) > .99).all()
    tried = documents(spark, [*rows, (300, unlearned, None)])
    got = {r.doc_id: r.rejected for r in lang_id.classify(tried, model).collect()}
    assert got == {i: i == 300 for i in got}
    # a far-off text of one language leaves the floors of the others alone
    low = lang_id.fit(documents(spark, rows + [(400 + i, unlearned[i * 9:] + "x" * i, "bb") for i in range(9)]))
    assert {f for x, f in zip(low.langs, low.floors) if x == "aa"} != {f for x, f in zip(low.langs, low.floors) if x == "bb"}


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert judged.where("lang = lang_pred").count() > 0.97 * judged.count()
    assert judged.where("rejected").count() == 0


def plain_language(text, model):
    """Nearest centroid by dictionaries of n-grams, one text at a time."""
    if not text or not lang_id.LETTER.search(text):
        return "und", 0.0, True
    shown = []
    for b in (" " + text.lower()).encode():
        b = b if b >= 128 or chr(b).isalpha() else 32
        if not (b == 32 and shown and shown[-1] == 32):
            shown.append(b)
    tf = {}
    for n, base in ((2, 0), (3, 1 << 24)):
        for i in range(len(shown) - n + 1):
            gram = base + sum(b << 8 * (n - 1 - k) for k, b in enumerate(shown[i:i + n]))
            place = (gram * 2654435761 & 0xFFFFFFFF) >> 19
            tf[place] = tf.get(place, 0) + 1
    weight = {p: (1 + np.log(c)) * float(model.idf[p]) for p, c in tf.items()}
    norm = sum(w * w for w in weight.values()) ** 0.5
    cos = [sum(w * float(c[p]) for p, w in weight.items()) / norm for c in model.centroids]
    best = max(range(len(cos)), key=lambda k: (cos[k], -k))
    return model.langs[best], cos[best], cos[best] < model.floors[best]


def test_language_predictions_as_plain_nearest_centroids(spark):
    words = {"aa": "kala mina sato rupi élan été", "bb": "thorn wedge blick frust straße", "cc": "над том река поле"}
    rows = [(i, prose(i, 5 + i % 60, words["abc"[i % 3] * 2]), "abc"[i % 3] * 2) for i in range(150)]
    rows += [(200, None, "aa"), (201, "7 !?", "bb"), (202, "zzz qqq xxx " * 20, None), (203, "A", None), (204, "kala\n\n--mina", "cc")]
    docs = documents(spark, rows)
    model = lang_id.fit(docs.where(~lang_id.held_out(F.col("doc_id"))))
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in lang_id.identify(docs).collect()}
    for i, text, _ in rows:
        lang, score, rejected = plain_language(text, model)
        assert got[i][0] == lang and got[i][1] == pytest.approx(min(max(score, 0), 1), abs=1e-4) and got[i][2] == rejected


def test_clusters_as_plain_spherical_means():
    r = np.random.default_rng(9)
    v = r.normal(size=(60, 12)) + np.repeat(r.normal(size=(4, 12)) * 3, 15, axis=0)
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    start = [int((v @ v.mean(axis=0)).argmax())]
    while len(start) < 4:
        start.append(min(range(60), key=lambda i: max(float(v[i] @ v[j]) for j in start)))
    centers = [v[i] for i in start]
    for _ in range(12):
        own = [max(range(4), key=lambda j: (float(x @ centers[j]), -j)) for x in v]
        sums = [sum((x for x, o in zip(v, own) if o == j), np.zeros(12)) if j in own else centers[j] for j in range(4)]
        centers = [s / np.linalg.norm(s) for s in sums]
    found, cos = lang_id.cluster(v, 4)
    assert np.allclose(found, centers, atol=1e-4)
    assert np.allclose(cos, [max(float(x @ c) for c in centers) for x in v], atol=1e-4)
