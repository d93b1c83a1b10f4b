"""Spelling variants against a plain search over all words one code point apart."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import spelling as C
from tests.llm.helpers import documents, rows_of

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def counted(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows):
    words = counted(rows)
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def corpus(seed, n_words=25, alphabet="abé"):
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(6, 11))) for _ in range(n_words)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(r.randrange(120)):
            w = base[int(r.random() ** 3 * n_words)]
            if r.random() < 0.2:
                p = r.randrange(len(w) + 1)
                w = r.choice([w[:p] + w[p + 1:], w[:p] + r.choice(alphabet) + w[p:], w[:p] + r.choice(alphabet) + w[p + 1:]])
            words.append(r.choice([w, w.upper().replace("É", "é"), w.capitalize()]))
        rows.append((i, r.choice([" ", "-", "中", "× ", "1"]).join(words)))
    return rows


@pytest.mark.parametrize("seed,limit", [(0, 32), (1, 1), (2, 3), (3, 1000), (4, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, limit):
    monkeypatch.setattr(C, "LEAST_LIMIT", limit)
    rows = corpus(seed)
    found = C.variants(documents(spark, [(i, t, "en") for i, t in rows]).withColumnRenamed("score", "word"))
    expected = brute(rows)
    assert sum(r[4] > 0 for r in expected) > 10
    assert rows_of(found) == rows_of(spark.createDataFrame(
        expected, "word string, form string, root string, n long, n_near long, form_n long"))


def test_chains_of_forms_are_followed_to_the_last(spark):
    words = ["abcdefgh" + "x" * i for i in range(5)]
    text = [" ".join([w] * (2 * 10 ** i)) for i, w in enumerate(words)]
    rows = [(None, t) for t in text]  # nothing is deleted without an id
    found = {r[0]: r for r in rows_of(C.variants(documents(spark, [(i, t, None) for i, t in rows])))}
    assert {r[2] for r in found.values()} == {words[-1]}
    assert found[words[0]][1] == words[1] and found[words[-1]][1] is None
    assert sorted(found.values()) == sorted(brute(rows))


def test_odd_rows(spark):
    long = "q" * 50_000
    rows = [(1, None), (2, ""), (3, "12 !?"), (None, "Straße Straße straßen straßen"), (5, f"{long} {long} {long}r {long}r"),
            (6, "ЖabcdefgЖ abcdefg abcdefgh abcdefgh"), (6, "abcdefgh ABCDEFGH"), (7, "ÀBCDEFG àbcdefg Àbcdefg")]
    found = C.variants(documents(spark, [(i, t, None) for i, t in rows]))
    assert rows_of(found) == rows_of(spark.createDataFrame(
        brute(rows), "word string, form string, root string, n long, n_near long, form_n long"))
    assert C.variants(documents(spark, [])).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"Longwordé{i % 17} 中abcdefgh" for i in range(500)) + " " + "z" * 300
    whole = C.runs(text, 7)
    monkeypatch.setattr(C, "PIECE_BYTES", 50)
    assert C.runs(text, 7) == whole
    assert whole["longwordé"] == 500 and whole["z" * 300] == 1


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=7, max_size=14), st.integers(0, 14), st.sampled_from("id r".split() + ["d", "r"]),
       st.sampled_from("abc"), st.integers(0, 400))
def test_near_words_meet_in_a_list(word, at, kind, letter, seed):
    """Under any dictionary that holds a gram only if it holds its beginning."""
    at %= len(word)
    other = {"i": word[:at] + letter + word[at:], "d": word[:at] + word[at + 1:]}.get(kind[0], word[:at] + letter + word[at + 1:])
    r = random.Random(seed)
    frequent = {}
    share = r.random()
    for w in ("^" + word + "$", "^" + other + "$"):
        for k in range(C.SHORTEST, C.LONGEST + 1):
            for p in range(len(w) - k + 1):
                g = w[p:p + k]
                if (k == C.SHORTEST or g[:-1] in frequent) and random.Random(f"{seed}{g}").random() < share:
                    frequent[g] = random.Random(g).randrange(1, 5)
    if other != word and len(other) >= 7:
        assert C.entries(word, frequent) & C.entries(other, frequent)
        grams, bound = C.decompose(word, frequent)
        theirs, _ = C.decompose(other, frequent)
        assert sum((Counter(grams) & Counter(theirs)).values()) >= len(grams) - bound
        assert bound <= C.LONGEST
