"""Centroid clustering against exact rounds over all centroids."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import centroids as C
from tests.llm.helpers import rows_of


def brute(vectors, k, rounds, dim, salt="2:"):
    """vectors: (id, integers) rows; cluster and distance per row, final centroids."""
    x = [v for _, v in vectors]
    first = {}
    for i, v in vectors:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    ids = sorted(first, key=lambda i: hashlib.sha256(f"{salt}{i}".encode()).hexdigest())[:k]
    centers = [first[i] for i in ids]
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers] for v in x]
        own = [row.index(min(row)) for row in d]
        if r < rounds:
            for j in range(len(centers)):
                mine = [v for v, o in zip(x, own) if o == j]
                if mine:
                    centers[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return own, [min(row) for row in d], centers


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance int")


@pytest.mark.parametrize("seed,k,rounds", [(0, 5, 4), (1, 40, 5), (2, 3, 0), (3, 9, 12)])
def test_equals_exact_rounds(spark, seed, k, rounds):
    r = np.random.default_rng(seed)
    groups = r.normal(size=(6, 8)) * 0.4
    x = np.concatenate([groups[r.integers(0, 6, 180)] + r.normal(size=(180, 8)) * 0.05, np.repeat(groups[:1], 60, axis=0)])
    rows = [(int(i), v.tolist(), "other", 7) for i, v in enumerate(x)]
    rows += [(3, rows[3][1], "repeat", 1), (500, rows[9][1], None, None), (None, rows[10][1], None, None)]
    vectors = [(i, np.floor(256 * np.array(v)).astype(int).tolist()) for i, v, *_ in rows]
    own, dist, centers = brute(vectors, k, rounds, 8)
    found = C.cluster(frame(spark, rows), dim=8, k=k, rounds=rounds)
    assert found.centroids.tolist() == centers
    assert rows_of(found.rows) == rows_of(spark.createDataFrame(
        [(i, o, d) for (i, _), o, d in zip(vectors, own, dist)], "vec_id long, cluster int, distance long"))
    assert found.inertia == [sum(d for d, o in zip(dist, own) if o == j) for j in range(len(centers))]


def test_bounds_spare_comparisons(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(100, 8)) * 0.02 + c for c in np.eye(8)])
    found = C.cluster(frame(spark, [(i, v.tolist(), "", 0) for i, v in enumerate(x)]), dim=8, k=8, rounds=5)
    assert found.scanned[0] == len(x)
    assert sum(found.scanned[1:]) < 2 * len(x)  # of 5 * len(x)
    assert sum(found.scanned[3:]) == 0


def test_only_whole_vectors_are_kept(spark):
    rows = [(1, [0.5, 1.0], "a", 1), (2, None, "a", 1), (3, [], "a", 1), (4, [0.5], "a", 1), (5, [0.5, None], "a", 1),
            (6, [0.5, float("nan")], "a", 1), (7, [float("inf"), 0.0], "a", 1), (8, [1e300, -1e300], "a", 1)]
    out = rows_of(C.digests(frame(spark, rows), dim=2, k=40, rounds=2))
    assert [r[0] for r in out] == [1, 8]
    assert [r[2] for r in out] == [0, 0]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, [0.5, 1.0], None, None)]])
def test_nothing_to_begin_with(spark, rows):
    assert C.digests(frame(spark, rows), dim=2).count() == 0


def test_large_components_stay_exact():
    x = np.array([[C.LARGEST, -C.LARGEST], [3, 4]])
    c = np.array([[-C.LARGEST, C.LARGEST], [0, 0]])
    assert C.distances(x, c).tolist() == [[8 * C.LARGEST ** 2, 2 * C.LARGEST ** 2],
                                          [(C.LARGEST + 3) ** 2 + (C.LARGEST - 4) ** 2, 25]]


def test_ties_go_to_the_smaller_cluster():
    now = C.Round(np.array([[0, 2], [0, -2], [0, 2]]), np.zeros(3), np.zeros(3), False)
    own, *_ = C.assign(np.array([[0, 0], [0, 2]]), np.zeros(0, np.int32), np.zeros(0), np.zeros(0), now)
    assert own.tolist() == [0, 0]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10 ** 6))
def test_no_vector_of_a_sphere_loses_more(seed):
    r = np.random.default_rng(seed)
    old = r.normal(size=(4, 3)) * 100
    new = old + r.normal(size=(4, 3)) * r.choice([0, 1, 50], size=(4, 1))
    radius = r.uniform(0, 120, size=4)
    bound = C.loosening(old, new, radius)
    for i in range(4):
        way = r.normal(size=(300, 3))
        x = old[i] + way / np.linalg.norm(way, axis=1, keepdims=True) * radius[i] * r.uniform(0, 1, size=(300, 1))
        for j in range(4):
            if j != i:
                loss = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert loss.max() <= bound[i] + 1e-6
        assert bound[i] <= np.delete(np.linalg.norm(new - old, axis=1), i).max() + 1e-9


def test_loosening_is_less_than_the_drift():
    old = np.array([[0, 0], [100, 0]])
    assert C.loosening(old, np.array([[0, 0], [110, 0]]), np.array([10.0, 10.0]))[0] == 0
    aside = C.loosening(old, np.array([[0, 0], [100, 10]]), np.array([10.0, 10.0]))[0]
    assert 0 < aside < 2
