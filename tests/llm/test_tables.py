"""WARC, chat, URL filter, decontamination, embeddings, the pipeline, SQL."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalspark.llm import chat, decontam, hnsw, queries, url_filter, warc
from tests.conftest import SF_SMALL
from tests.llm.helpers import documents, prose, rows_of


def test_warc_round_trip_and_revisits(spark):
    body = "payload é " * 20
    rows = [(5, "http://a/1", body), (3, "http://a/\n2%0A", body), (9, None, body), (3, "http://a/3", body),
            (None, "http://a/4", body), (1, "http://b", "short"), (2, "http://b", "short"), (4, "http://c", None),
            (6, "http://c", ""), (7, "http://d", "\x1f\x8b\x08" * 50), (8, "http://e", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = warc.read_archives(warc.write_archives(pages.repartition(3)), split=97).collect()
    assert sorted((r.page_id or -1, r.url or "") for r in got) == sorted((p or -1, u or "") for p, u, _ in rows)
    kind = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in got}
    assert kind[5, "http://a/1"] == kind[9, None] == ("revisit", 3)
    assert all(kind[k] == ("response", None) for k in kind if k not in {(5, "http://a/1"), (9, None)})
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {h or "" for _, _, h in rows}
    assert warc.round_trip(pages).count() == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 10**6])
def test_warc_ranges_own_each_record_once(split):
    r = random.Random(split)
    noise = bytes(r.randrange(256) for _ in range(3000))
    data = b"".join(warc.member(i, "u", noise[:r.randrange(3000)] + warc.MAGIC, "d", None) for i in range(12))
    found = [warc.parse(x)["page_id"] for a in range(0, len(data), split)
             for x in warc.scan(pa.BufferReader(data), a, min(a + split, len(data)), len(data))]
    assert found == list(range(12))


def test_chat_snapshots(spark):
    say = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rows = [*say(1, "a"), *say(2, "a", "b"), *say(3, "a", "b", "c"), *say(4, "a", "b", "c"), *say(5, "a", "x"),
            *say(6, "b"), *say(None, "q", None), *say(7, "q", "", "z"), *say(6, "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("place", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.chat_texts(turns).collect()}
    # rows without an id are by themselves: "q" begins 7, the empty answer is a conversation
    assert {k: v[:2] for k, v in got.items()} == {3: (3, 2), 5: (2, 1), 6: (1, 1), 7: (3, 1), None: (1, 1)}
    assert got[None][2] == "<|im_start|>assistant\n<|im_end|>\n"
    assert got[5][2] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    equal = spark.createDataFrame([*say(None, "k"), *say(8, "k")], turns.drop("place").schema)
    assert [tuple(r)[:3] for r in chat.chat_texts(equal).collect()] == [(None, 1, 2)]
    assert chat.chat_texts(turns.limit(0)).count() == 0


def test_chat_as_lists_of_turns(spark, monkeypatch):
    """Snapshots, copies, nulls and long conversations against the SQL that compares whole lists."""
    r = random.Random(7)
    base = [[("user", r.choice("abc")) if i % 2 == 0 else ("assistant", r.choice("ab")) for i in range(r.randrange(1, 40))]
            for _ in range(12)]
    rows = []
    for c in range(80):
        b = base[c % 12]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(b[:r.randrange(1, len(b) + 1)])]
    rows += [(None, r.choice([0, None]), r.choice(["user", None]), r.choice("abq")) for _ in range(30)] + rows[:9]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    con = duckdb.connect()
    frame = turns.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    want = sorted(map(str, con.sql(chat.ORACLE).fetchall()))
    for size in (50_000, 5):
        monkeypatch.setattr(chat, "RANGE_TURNS", size)
        assert sorted(str(tuple(r)) for r in chat.chat_texts(turns).collect()) == want


def test_url_filter(spark):
    entries = spark.createDataFrame([*queries.URL_RULES, ("net", "/es/", "allow"), (None, None, "block")][:6],
                                    "host string, path string, verdict string")
    urls = {1: "https://WWW.Example.com/en/x?q#f", 2: "http://example.com/en/1", 3: "http://a.example.com/en", 4: None,
            5: "x.net/es/", 6: "ftp://x.net/es/a", 7: "http://notnet/es/", 8: "http://net/fr/?a", 9: "http://com",
            10: "http://b.org/a://c.com/", 11: "http://x.NET/ES/"}
    pages = spark.createDataFrame([*urls.items(), (1, urls[1])], "page_id long, url string").withColumn("rule", F.lit(0))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, entries).collect()}
    assert url_filter.judge(pages, entries).count() == 12
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[3] == ("a.example.com", "/en", "com/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("x.net", "/es/a", "net/es/", "block") and got[8][3] == "block"
    assert got[7][2] is got[9][2] is got[10][2] is got[11][2] is None
    assert {r.verdict for r in url_filter.judge(pages, entries.limit(0)).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), entries).count() == 0


def test_bloom_filter_has_no_false_negatives(spark):
    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    for most in (1 << 25, 256):  # far too small a filter lets more through, never less
        table = url_filter.build_filter(hashes, 5000, max_bytes=most)
        test = url_filter.maybe_listed(table, hashes)
        assert hashes.where(test("h")).count() == 5000
    assert table.nbytes <= 256
    table = url_filter.build_filter(hashes, 5000)
    other = spark.range(5000, 25000).select(F.xxhash64("id").alias("h"))
    assert other.where(url_filter.maybe_listed(table, other)("h")).count() < 400


def test_decontamination(spark):
    item, short = prose(50, 40), "one two three four"
    edit = item.split()
    edit[0] = "changed"
    rows = [(1, f"{prose(1, 30)} {item.upper()}! {prose(2, 30)}", "en"), (2, " ".join(edit), "en"),
            (3, " ".join(w + "x" * (k % 7 == 0) for k, w in enumerate(item.split())), "en"), (4, None, None), (5, "", "en"),
            (6, short, "en"), (None, item, "en"), (7, item, "en"), (7, item, "en"), (8, prose(8, 3000), "en")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(10, item), (10, item), (11, short), (12, None), (None, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(docs, bench).collect()}
    assert got == {(1, 10): 1.0, (2, 10): pytest.approx(35 / 37), (7, 10): 1.0}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    # the row without an id is judged too: its text is the item
    assert rows_of(kept) == rows_of(docs.where("doc_id not in (1, 2, 7)"))
    assert decontam.matches(docs.limit(0), bench).count() == decontam.matches(docs, bench.limit(0)).count() == 0


def test_decontamination_judges_windows_at_every_offset(spark):
    w = [f"{x}{i}" for i, x in enumerate(prose(60, 59).split())]
    half = w[29:] + w[:29]
    edges = ["one", *w[1:29], "two", "three", *w[29:-1], "four"]
    around = lambda k, text: f"{prose(k, 40)} {' '.join(text)} {prose(k + 1, 40)}"
    twice = [*w[:50], "x", *w[:50], *w[50:]]
    rows = [(1, around(1, half)), (2, around(3, edges)), (3, " ".join(half)), (4, " ".join(w[3:])),
            (5, around(5, twice)), (6, around(7, w[:30])), (9, around(9, half)), (7, around(11, w[:9] + w[20:29])),
            (8, around(13, half) + " " + around(15, edges))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(w)), (11, " ".join(w[:20])), (12, prose(61, 59))], "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    want = {(d, i): s for d, i, s in con.sql(decontam.ORACLE).fetchall()}
    assert {(1, 10), (2, 10), (3, 10), (8, 10), (9, 10)} <= set(want)
    assert {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(docs, bench).collect()} == pytest.approx(want)


def test_decontamination_of_long_and_repetitive_texts(spark, monkeypatch):
    item, other = prose(70, 60), prose(71, 60)
    rows = [(1, f"{item} " * 1500), (2, " ".join(prose(80 + i, 2000) for i in range(30)) + f" {other} " + prose(99, 500)),
            (3, "x" * 300_000 + " " + item), (4, "Σ" * 1000 + " ΑΣ'Α " + prose(5, 20_000))]
    docs = spark.createDataFrame([(i, t) for i, t in rows] + [(10 + i, rows[0][1]) for i in range(5)],
                                 "doc_id long, text string")
    docs = docs.withColumns({c: docs.doc_id for c in ("k1", "h1", "size", "key", "words", "item_id")})
    bench = spark.createDataFrame([(10, item), (11, other), (12, prose(72, 25))], "item_id long, text string")
    want = {(i, 10) for i in (1, 3, 10, 11, 12, 13, 14)} | {(2, 11)}
    for size, pieces in ((1 << 14, 1 << 19), (700, 20_000)):
        monkeypatch.setattr(decontam, "RANGE", size)
        monkeypatch.setattr(decontam, "PIECE_CHARS", pieces)
        got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(docs, bench).collect()}
        assert got == dict.fromkeys(want, 1.0)
        kept = decontam.clean(docs, bench)
        assert kept.columns == docs.columns and [r.doc_id for r in kept.select("doc_id").collect()] == [4]


def test_fingerprints_are_majorities(spark):
    import numpy as np
    r = np.random.default_rng(3)
    sets = [r.integers(-2 ** 63, 2 ** 63, n).tolist() for n in (1, 2, 3, 7, 8, 31, 64, 100)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sets)], "i int, parts array<long>")
    got = {r.i: r.fp for r in df.select("i", decontam.fingerprint("parts", 104).alias("fp")).collect()}
    for i, x in enumerate(sets):
        bits = np.unpackbits(np.array(x, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        assert got[i] == int(np.packbits(2 * bits.sum(0) > len(x), bitorder="little").view("<i8")[0])


@pytest.mark.parametrize("seed", [0, 1])
def test_graph_finds_every_neighbour(seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, 32))
    v = np.concatenate([centre.repeat(30, 0) + .1 * rng.normal(size=(1200, 32)), rng.normal(size=(800, 32))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw.Graph.build(v.astype(np.float32))
    want = v @ v.T >= .9
    got = hnsw.links_in(graph, v, v, .9)
    assert all(want[i, own].all() for i, own in enumerate(got))
    assert sum(map(len, got)) >= .99 * want.sum()


def test_graph_audit_needs_evidence():
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    v, q = unit(rng.normal(size=(3000, 64))), rng.normal(size=(600, 64))
    linked = np.setdiff1d(np.arange(5, 600, 10), np.linspace(0, 599, 12).astype(int))
    q[linked] = 8 * v[linked] + .35 * rng.normal(size=(len(linked), 64))  # sparse links, none at twelve even places
    q, graph = unit(q), hnsw.Graph.build(v.astype(np.float32))
    graph.layers[0][:, 4:] = -1  # a beam of 24 misses some
    want = q @ v.T >= .9
    assert want.sum() == len(linked)
    assert sum(map(len, graph.within(q.astype(np.float32), .9, hnsw.BEAM))) < .9 * len(linked)
    got = hnsw.links_in(graph, v, q, .9)
    assert sum(map(len, got)) >= .99 * len(linked) and all(want[i, x].all() for i, x in enumerate(got))


def test_graph_audit_leaves_out_the_vectors_themselves():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(2000, 48))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph, places = hnsw.Graph.build(v.astype(np.float32)), np.arange(2000)
    graph.layers[0][:] = -1  # finds next to nothing but itself
    assert hnsw.audited_beam(graph, v, v, places, .9) == 0
    assert hnsw.audited_beam(graph, v[:1], v[:1], places[:1], .9) == 0
    assert [x.tolist() for x in hnsw.links_in(graph, v, v, .9, places)] == [[i] for i in places]


def test_embedding_components(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(5, 16))
    vectors = [(i, (base[i % 5] + .02 * rng.normal(size=16)).tolist()) for i in range(60)]
    vectors += [(100, vectors[0][1]), (101, None), (102, [0.0] * 16), (103, [float("nan")] * 16), (104, [1.0, None] * 8),
                (105, [float("inf")] * 16), (106, [1.0] * 3), (107, [2.0] * 3), (None, vectors[1][1])]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("n_links", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(rows).collect()}
    for i in range(60):
        assert got[i] == (11 + (i % 5 < 2), i % 5, i < 5)
    assert got[100] == (12, 0, False) and got[107] == (1, 106, False)
    assert all(got[i] == (0, i, True) for i in range(101, 106))
    assert hnsw.near_duplicates(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, duck_small, name):
    got = queries.QUERIES[name](spark, SF_SMALL)
    want = duck_small.sql(queries.ORACLES[name]).df()
    norm = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(
        df[sorted(df.columns)].notna(), None).map(lambda v: int(v) if isinstance(v, float) and v == int(v) else v
                                                  ).values.tolist()))
    assert norm(got.toPandas()) == norm(want)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))


def test_pipeline(spark, tmp_path):
    item = prose(77, 30)
    long = prose(5, 300)
    rows = [(i, prose(i, 60), "en") for i in range(20)] + [
        (30, "1234 !!", "en"), (31, None, None), (32, long, "en"), (33, long + " end", "en"),
        (34, f"{prose(34, 50)} {item} {prose(35, 50)}", "en"), (36, prose(36, 40) + " " + prose(7, 60)[:200], "en")]
    documents(spark, rows).drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(20), 32, 36}
    assert all(got[i].n_tokens * 4 == len(got[i].ids) for i in got)
    whole = queries.bpe.digests(spark.createDataFrame([(36, rows[-1][1])], "doc_id long, text string"),
                                queries.public_tokenizers.path("byte_bpe_50k.json")).first()
    assert got[36].n_tokens < whole.n_tokens


def sql_rows(oracle, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, pa.Table.from_pylist(table))
    found = con.sql(oracle)
    order = sorted(range(len(found.columns)), key=found.columns.__getitem__)
    return sorted(str(tuple(row[i] for i in order)) for row in found.fetchall())


def frame_rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def test_warc_as_sql_with_equal_payloads(spark):
    r = random.Random(2)
    bodies = ["x" * n for n in (0, 99, 100, 101)] + [f"<p>{i}</p>" * 40 for i in range(5)]
    pages = [{"page_id": i, "url": f"http://h/{i}", "html": r.choice([*bodies, None, f"own {i}" * 30])} for i in range(300)]
    r.shuffle(pages)
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4))
    assert got.where("record_type = 'revisit'").count() > 150
    assert frame_rows(got) == sql_rows(warc.ORACLE, pages=pages)


def test_url_filter_as_sql_with_odd_and_long_hosts(spark):
    r = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "net", "x.net", "notnet", "a..net", ".net", "net.", "",
             "b." * 20_000 + "net", "c" * 5000 + ".com", "EXAMPLE.com", "org"]
    urls = [f"{s}{h}{p}" for h in hosts for s in ("http://", "https://", "") for p in ("", "/", "/en/", "/es/a?b", "/fr/#c", "?/es/", "/EN/")]
    pages = [{"page_id": i, "url": u} for i, u in enumerate([*urls, None, r.choice(urls)])]
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), rules)
    assert got.where("verdict = 'block'").count() > 10
    assert frame_rows(got) == sql_rows(url_filter.ORACLE, pages=pages)


def test_embedding_links_as_sql_with_near_copies(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(40, 16))
    rows = [{"vec_id": i, "embedding": v.tolist()} for i, v in enumerate(
        np.concatenate([base, base[:25] + r.normal(size=(25, 16)) * 0.2, base[:25] + r.normal(size=(25, 16)) * 0.45, base[:6], 3 * base[:6]]))]
    rows += [{"vec_id": 500, "embedding": None}, {"vec_id": 501, "embedding": [0.0] * 16}, {"vec_id": 502, "embedding": []},
             {"vec_id": 503, "embedding": [1.0, None] * 8}, {"vec_id": 504, "embedding": [float("nan")] * 16}]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9)
    assert got.where("n_links > 0").count() > 50 and got.where("component_id <> vec_id").count() > 30
    assert frame_rows(got) == sql_rows(hnsw.ORACLE, embeddings=rows)
