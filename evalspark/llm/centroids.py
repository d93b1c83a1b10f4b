"""Centroid clustering (k-means over integer vectors) with geometric drift tightening.

A vector keeps its cluster, an upper bound of the distance to its own
centroid and a lower bound of the distance to any other. When centroids move,
the lower bound is loosened not by the largest move but by what the moves can
cost a point of its own cluster: the cluster's vectors lie in a sphere around
the old centroid, with the largest upper bound as radius, and in the plane
through that centre and a moving centroid's old and new place,

    |x - old| - |x - new|  <=  move * cos(angle at the midpoint between x and the move).

The sphere, seen from the midpoint, fills a cone around its centre; the
smallest angle in the cone bounds the loss for all of its vectors, which is
the full move only if the cone holds the move's direction, and nothing if the
cone lies behind the midpoint. A vector whose upper bound stays below its
lower one keeps its cluster without a distance; else its own distance is
taken, and only vectors still ambiguous are compared with all centroids, in
exact integers. Bounds are widened for rounding, so results are exact.

Vectors travel in blocks, one row a block, which each round rewrites as a
table in the shared folder with the new bounds; a lost executor costs that
round's tasks. Sums are of moved vectors only, added up by cluster and place in
Spark, so the driver holds k centroids and their sums, and a cluster with a
third of all vectors is no larger for any task.

Defined results: only vectors with exactly ``dim`` components, none null or not
finite, are kept; the others have no row. A component becomes
floor(scale * x), held to +-2**27 (|x| of half a million at scale 256), so that
distances fit a long. Seeds are the vectors with the smallest hash of their
id; of equal ids the vector first in order of components; rows with a null id
are no seeds but are clustered. Fewer vectors than ``k``: as many clusters.
Equal distances: the smaller cluster. Repeated rows each come back; other
columns are not carried; an inertia beyond a long is null; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.graph import drop_written, written

BLOCK_BYTES = 1 << 20
LARGEST = 1 << 27
#: Widening of bounds for rounding, relative and absolute.
SLACK = 1e-9
STATE = ("ids array<long>, x binary, own binary, upper binary, lower binary, "
         "cluster int, sums array<long>, radius double, scanned long, high long, low long")
FIELDS = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("own", pa.binary()),
                    ("upper", pa.binary()), ("lower", pa.binary()), ("cluster", pa.int32()),
                    ("sums", pa.list_(pa.int64())), ("radius", pa.float64()), ("scanned", pa.int64()),
                    ("high", pa.int64()), ("low", pa.int64())])


def scaled(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are kept, and their components as integers."""
    column = column.cast(pa.list_(pa.float64()))
    rows = np.flatnonzero(pc.equal(pc.list_value_length(column), dim).fill_null(False).to_numpy(zero_copy_only=False))
    if not len(rows):
        return rows, np.zeros((0, dim), np.int64)
    flat = column.take(pa.array(rows)).flatten()
    whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dim).all(axis=1)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = whole & np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        return rows[good], np.clip(np.floor(scale * values[good]), -LARGEST, LARGEST).astype(np.int64)


def own_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each vector to the centroid of its row."""
    step = x.astype(np.int64) - centroids
    return np.einsum("ij,ij->i", step, step)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:  # every sum is a whole number that a double holds
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([own_distances(x, c) for c in centroids], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster: the most that the distance from a vector of its sphere
    to any other centroid can have shrunk."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    out = np.zeros(len(old))
    for j in range(len(old)):
        move = new[j] - old[j]
        size = float(np.linalg.norm(move))
        if size == 0:
            continue
        there = old - (old[j] + new[j]) / 2
        far = np.linalg.norm(there, axis=1)
        outside = far > radius
        safe = np.where(outside, far, 1.0)
        angle = np.arccos(np.clip(there @ move / (safe * size), -1, 1)) - np.arcsin(
            np.where(outside, np.minimum(radius / safe, 1), 1))
        loss = np.where(outside, size * np.maximum(np.cos(np.clip(angle, 0, np.pi)), 0), size)
        loss[j] = 0
        out = np.maximum(out, loss)
    return out


@dataclass
class Round:
    """What a round needs: centroids, and per cluster how far its own centroid
    moved and how much the lower bounds of its vectors are loosened."""

    centroids: np.ndarray
    moved: np.ndarray
    loosened: np.ndarray
    last: bool


@dataclass
class Clustering:
    """Rows (id, cluster, distance), the centroids, per cluster the sum of
    distances, and the vectors compared with all centroids in each round."""

    rows: DataFrame
    centroids: np.ndarray
    inertia: list[int]
    scanned: list[int] = field(default_factory=list)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray,
           now: Round) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New cluster and bounds of a block; which vectors were compared with all."""
    k = len(now.centroids)
    scan = np.ones(len(x), bool)
    if len(own):
        upper = (upper + now.moved[own]) * (1 + SLACK)
        lower = lower - now.loosened[own] * (1 + SLACK) - SLACK
        unclear = np.flatnonzero(upper >= lower)
        upper[unclear] = np.sqrt(own_distances(x[unclear], now.centroids[own[unclear]])) * (1 + SLACK)
        scan = upper >= lower
    else:
        own, upper, lower = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x))
    some = np.flatnonzero(scan)
    for at in range(0, len(some), step := max(1, (1 << 20) // k)):
        part = some[at:at + step]
        d = distances(x[part], now.centroids)
        near = d.argmin(axis=1)  # the first of equals
        own[part], upper[part] = near, np.sqrt(d[np.arange(len(part)), near]) * (1 + SLACK)
        d[np.arange(len(part)), near] = np.iinfo(np.int64).max
        lower[part] = np.sqrt(d.min(axis=1)) * (1 - SLACK) if k > 1 else np.inf
    return own, upper, lower, scan


def _blocks(dim: int, scale: float):
    rows = max(1, BLOCK_BYTES // (4 * dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = scaled(batch.column(1), dim, scale)
            ids = batch.column(0).take(pa.array(kept))
            for at in range(0, len(kept), rows):
                yield _row(ids[at:at + rows], x[at:at + rows].astype("<i4").tobytes(), b"", b"", b"")
    return run


def _row(ids: pa.Array, *state: bytes) -> pa.RecordBatch:
    cells = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64()))]
    cells += [pa.array([s], pa.binary()) for s in state]
    return pa.RecordBatch.from_arrays(cells + [pa.nulls(1, f.type) for f in list(FIELDS)[5:]], schema=FIELDS)


def _pass(dim: int, shared):
    """A round over blocks: the blocks with new bounds, then one row a cluster
    with the sums of vectors that came and went, the radius and the distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Round = shared.value
        k = len(now.centroids)
        sums, radius = np.zeros((k, dim + 1), np.int64), np.zeros(k)
        scanned, total = np.zeros(k, np.int64), [0] * k
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda name, kind: np.frombuffer(
                    batch.column(batch.schema.get_field_index(name))[i].as_py(), kind)
                x = cell("x", "<i4").reshape(-1, dim).astype(np.int64)
                before = cell("own", "<i4")
                own, upper, lower, scan = assign(
                    x, before.copy(), cell("upper", "<f8").copy(), cell("lower", "<f8").copy(), now)
                moved = own != before if len(before) else np.ones(len(own), bool)
                _add_up(sums, own[moved], x[moved], 1)
                if len(before):
                    _add_up(sums, before[moved], x[moved], -1)
                if now.last:
                    d = own_distances(x, now.centroids[own])
                    upper = d.astype("<i8").view("<f8")  # the last table holds distances
                    for c in np.unique(own):
                        total[c] += int(d[own == c].sum(dtype=object))
                else:
                    np.maximum.at(radius, own, upper)
                scanned += np.bincount(own[scan], minlength=k)
                yield _row(batch.column(0)[i].values, x.astype("<i4").tobytes(), own.astype("<i4").tobytes(),
                           upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes())
        used = np.flatnonzero(sums.any(axis=1) | (radius > 0) | (scanned > 0) | np.array([t > 0 for t in total]))
        yield pa.RecordBatch.from_pydict({
            "ids": pa.nulls(len(used), FIELDS.field("ids").type),
            **{c: pa.nulls(len(used), pa.binary()) for c in ("x", "own", "upper", "lower")},
            "cluster": used.astype(np.int32), "sums": list(sums[used]), "radius": radius[used],
            "scanned": scanned[used], "high": [total[c] >> 32 for c in used],
            "low": [total[c] & 0xFFFFFFFF for c in used]}, schema=FIELDS)
    return run


def _add_up(sums: np.ndarray, own: np.ndarray, x: np.ndarray, sign: int) -> None:
    """Adds vectors, and in the last place their number, to the sums of their clusters."""
    if len(own):
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        at = own[order][first]
        sums[at, :-1] += sign * np.add.reduceat(x[order], first, axis=0)
        sums[at, -1] += sign * np.diff(first, append=len(own))


def seeds(vectors: DataFrame, k: int, salt: str, dim: int, scale: float) -> np.ndarray:
    """The k kept vectors with the smallest sha256 of ``salt`` and id, as integers.
    Each task passes on its k smallest, so a distributed top-k with k rows for the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[int, list[int]]] = {}
        for batch in batches:
            kept, x = scaled(batch.column(1), dim, scale)
            found = [(hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), n, i)
                     for n, i in enumerate(batch.column(0).take(pa.array(kept)).to_pylist()) if i is not None]
            limit = max(best) if len(best) == k else "g"  # after every hexadecimal digit
            for h, n, i in found:
                if h <= limit:
                    row = (i, x[n].tolist())
                    best[h] = min(best.get(h, row), row)
            best = {h: best[h] for h in sorted(best)[:k]}
        yield pa.RecordBatch.from_pydict({
            "h": pa.array(list(best), pa.string()),
            "x": pa.array([x for _, x in best.values()], pa.list_(pa.int64()))})

    few = vectors.mapInArrow(run, "h string, x array<long>")
    found = few.groupBy("h").agg(F.min("x").alias("x")).orderBy("h").limit(k).collect()
    return np.array([r.x for r in found], np.int64).reshape(-1, dim)


def cluster(df: DataFrame, id: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 40,
            rounds: int = 5, scale: float = 256.0, salt: str = "2:") -> Clustering:
    """k-means: ``rounds`` assignments each followed by new centroids (floors of
    the exact means; an empty cluster's stays), then one more assignment."""
    spark = df.sparkSession
    vectors = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    centroids = seeds(vectors, k, salt, dim, scale)
    if not len(centroids):  # nothing to begin with: no vector, or none with an id
        return Clustering(spark.createDataFrame([], f"{id} long, cluster int, distance long"), centroids, [])
    state, path = written(vectors.mapInArrow(_blocks(dim, scale), STATE), "vector-blocks")
    sums = np.zeros((len(centroids), dim + 1), object)
    now = Round(centroids, np.zeros(len(centroids)), np.zeros(len(centroids)), rounds == 0)
    scanned: list[int] = []
    for i in range(rounds + 1):
        shared = spark.sparkContext.broadcast(now)
        # rows of blocks only; those of the sums are read apart
        after, after_path = written(state.where("x is not null").mapInArrow(_pass(dim, shared), STATE), "vector-blocks")
        drop_written(spark, path)
        shared.unpersist()
        state, path = after, after_path
        stats = state.where("cluster is not null")
        by = stats.groupBy("cluster").agg(F.max("radius"), F.sum("scanned"), F.sum("high"), F.sum("low")).collect()
        scanned.append(sum(r[2] for r in by))
        if i == rounds:
            break
        for r in stats.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(
                F.sum("col").alias("s")).where("s <> 0").collect():
            sums[r.cluster, r.pos] += r.s
        new = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else list(old)
                        for row, old in zip(sums, centroids.tolist())], np.int64)
        radius = np.zeros(len(centroids))
        for r in by:
            radius[r[0]] = r[1]
        now = Round(new, np.linalg.norm((new - centroids).astype(np.float64), axis=1),
                    loosening(centroids, new, radius), i == rounds - 1)
        centroids = new
    inertia = [0] * len(centroids)
    for r in by:
        inertia[r[0]] = (r[3] << 32) + r[4]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own, upper in zip(*batch.columns):
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(np.frombuffer(own.as_py(), "<i4")),
                     pa.array(np.frombuffer(upper.as_py(), "<i8"))], [id, "cluster", "distance"])

    found = state.where("x is not null").select("ids", "own", "upper").mapInArrow(
        rows, f"`{id}` long, cluster int, distance long")
    return Clustering(found, centroids, inertia, scanned)


def digests(df: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = cluster(df, **options)
    held = lambda n: n if n < 1 << 63 else None
    table = [(c, held(total), held(sum(found.inertia)),
              hashlib.sha256(",".join(map(str, place)).encode()).hexdigest())
             for c, (total, place) in enumerate(zip(found.inertia, found.centroids.tolist()))]
    of = df.sparkSession.createDataFrame(
        table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(of), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2:") -> str:
    """The same by comparing every vector with every centroid in every round."""
    d = "list_sum(list_transform(generate_series(1, {dim}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))".format(dim=dim)
    parts = [f"""v as materialized (
      select row_number() over () as r, vec_id,
             list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) as x from embeddings
      where len(embedding) = {dim} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dim}),
    c0 as materialized (
      select row_number() over (order by h) - 1 as c, x from (
        select sha256('{salt}' || vec_id::varchar) as h, min(x) as x from v where vec_id is not null group by vec_id)
      qualify row_number() over (order by h) <= {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (
      select r, any_value(vec_id) as vec_id, any_value(vx) as x, arg_min(c, (d, c)) as c, min(d) as d from (
        select v.r, v.vec_id, v.x as vx, c.c, {d} as d from v, c{i} c) group by r)""")
        if i < rounds:
            parts.append(f"""c{i + 1} as materialized (
      select c{i}.c, coalesce(n.x, c{i}.x) as x from c{i} left join (
        select c, list(m order by p) as x from (
          select c, p, ((s - ((s % n) + n) % n) // n)::bigint as m from (
            select c, p, sum(x[p])::hugeint as s, count(*)::hugeint as n
            from a{i}, (select unnest(generate_series(1, {dim})) as p) group by c, p)) group by c) n using (c))""")
    last = f"a{rounds}"
    return f"""with {", ".join(parts)}
    select vec_id, {last}.c::integer as cluster, d::bigint as distance,
           (sum(d) over (partition by {last}.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
           sha256(array_to_string(c{rounds}.x, ',')) as centroid_sha256
    from {last} join c{rounds} using (c)"""


ORACLE = oracle()
