"""Embedding near-dedup over navigable small-world graphs, one per shard.

Distinct vectors are dealt to shards by hash, and a task builds the layered
graph of its shard: vectors come in waves, each wave is searched against the
graph so far and against itself, and keeps diverse neighbours. Then every
vector is searched in every shard. A beam that is full of links is doubled
until it holds more than links; a share of the vectors of every batch is audited
against the whole shard, and the beams of a batch are widened until the
audit finds ``RECALL`` of their ``NEAREST`` nearest other vectors, which exist
however sparse links are, and of their links. A batch whose audit fails at
``WIDEST`` is compared with every vector of the shard. Cosines are verified in double precision,
a task returns link counts and a spanning forest of the links it found, and
components are united from those.

Graphs are files in the shared folder, named by a table that Spark commits;
a query task reads those of the shards it has rows for. ``SHARDS`` does not
grow with the input until a shard exceeds ``SHARD_BYTES`` of vectors, whatever their dimension.

Defined results: vectors that are null, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link;
equal vectors are one node, and copies count as links of one another; rows
with a null vec_id count as links but name no component; other columns are
not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.graph import Forest, components, new_folder, written
from evalspark.llm.warc import _at

SHARDS = 6
SHARD_BYTES = 100 << 20
#: Query tasks for each task slot, at most; a task then takes several blocks of a shard.
TASKS_A_SLOT = 64
LINKS = 12
BUILD_BEAM = 40
BEAM = 24
UPPER_BEAM = 4
WAVE = 512
VISITED = 1 << 25
#: Vectors audited in a batch: one of AUDIT_SHARE, and AUDITS at least.
AUDITS = 32
AUDIT_SHARE = 32
AUDIT_BYTES = 1 << 25
NEAREST = 4
#: Widest beam tried by an audit; wider ones cost more than the whole shard.
WIDEST = 192
RECALL = 0.99
QUERY_ROWS = 4096


class Graph:
    """Layered small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], top: int):
        self.v, self.layers, self.top = vectors, layers, top

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> "Graph":
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int), 8)
        level[0] = max(int(level.max(initial=0)), 0)
        layers = [np.full((n, LINKS * (2 if h == 0 else 1)), -1, np.int32) for h in range(level[0] + 1)]
        graph = cls(vectors, layers, 0)
        done = 1
        while done < n:
            end = min(n, done + min(WAVE, done))
            graph._insert(np.arange(done, end), level)
            done = end
        return graph

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        q = self.v[new]
        entry = np.full((len(new), 1), self.top, np.int32)
        within = q @ q.T
        for h in range(len(self.layers) - 1, -1, -1):
            members = level[new] >= h
            beam = BUILD_BEAM if members.any() else UPPER_BEAM
            ids, sims = self.search(q, h, entry, beam)
            entry = ids[:, :UPPER_BEAM]
            if not members.any():
                continue
            # the wave itself: earlier places of it are candidates as well
            own = np.where(members[None, :] & (new[None, :] < new[:, None]), within, -2.0)
            near = np.argsort(-own, axis=1, kind="stable")[:, :BUILD_BEAM]
            own = np.take_along_axis(own, near, 1)
            ids = np.concatenate([ids, np.where(own > -2, new[near], -1)], 1)
            sims = np.concatenate([sims, own], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, order, 1)[members], np.take_along_axis(sims, order, 1)[members]
            width = self.layers[h].shape[1]
            chosen = self._diverse(ids, sims, LINKS)
            self.layers[h][new[members], :LINKS] = chosen
            self._reverse(h, np.repeat(new[members], LINKS), chosen.ravel(), width)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Up to ``keep`` of the sorted candidates: first those nearer to the
        vector than to any kept before, then the nearest of the others."""
        rows, width = ids.shape
        v = self.v[np.maximum(ids, 0)]
        among = np.einsum("rid,rjd->rij", v, v)
        kept = np.zeros((rows, width), bool)
        for j in range(width):
            shadow = (np.where(kept[:, :j], among[:, j, :j], -2).max(axis=1, initial=-2) >= sims[:, j])
            kept[:, j] = (ids[:, j] >= 0) & ~shadow & (kept[:, :j].sum(axis=1) < keep)
        rank = np.where(ids < 0, 2 * width, np.where(kept, 0, width)) + np.arange(width)
        order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        out = np.take_along_axis(ids, order, 1)
        if out.shape[1] < keep:
            out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
        return out

    def _reverse(self, h: int, source: np.ndarray, target: np.ndarray, width: int) -> None:
        """Adds the way back of new links; full lists are chosen anew."""
        keep = target >= 0
        source, target = source[keep], target[keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        while len(target):
            first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            turn = np.arange(len(target)) - np.repeat(first, np.diff(np.concatenate([first, [len(target)]])))
            now = turn < width
            nodes = target[first]
            more = np.full((len(nodes), width), -1, np.int32)
            more[np.searchsorted(nodes, target[now]), turn[now]] = source[now]
            ids = np.concatenate([self.layers[h][nodes], more], 1)
            sims = np.where(ids >= 0, np.einsum("rd,rjd->rj", self.v[nodes], self.v[np.maximum(ids, 0)]), -2.0)
            by = np.argsort(-sims, axis=1, kind="stable")
            self.layers[h][nodes] = self._diverse(
                np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1), width)
            source, target = source[~now], target[~now]

    def search(self, q: np.ndarray, h: int, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams of a layer: ids (-1: none) and similarities, best first."""
        rows = max(1, VISITED // max(len(self.v), 1))
        parts = [self._search(q[i:i + rows], h, entry[i:i + rows], beam) for i in range(0, len(q), rows)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, h: int, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, links = len(q), self.layers[h]
        seen = np.zeros((n, len(self.v) + 1), bool)  # the last column takes the places without a node
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -2.0, np.float32)
        open_ = np.zeros((n, beam), bool)
        rows, found = np.arange(n), entry
        while len(rows):
            fresh = (found >= 0) & ~seen[rows[:, None], found]
            seen[rows[:, None], found] = True
            near = np.where(fresh, np.einsum("rd,rjd->rj", q[rows], self.v[np.maximum(found, 0)]), -2.0)
            all_ids = np.concatenate([ids[rows], np.where(fresh, found, -1)], 1)
            all_sims = np.concatenate([sims[rows], near], 1)
            all_open = np.concatenate([open_[rows], fresh], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[rows], sims[rows], open_[rows] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_sims, all_open))
            rows = rows[open_[rows].any(axis=1)]
            at = open_[rows].argmax(axis=1)
            open_[rows, at] = False
            found = links[ids[rows, at]]
        return ids, sims

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(q), 1), self.top, np.int32)
        for h in range(len(self.layers) - 1, 0, -1):
            entry = self.search(q, h, entry, UPPER_BEAM)[0]
        return self.search(q, 0, entry, beam)

    def within(self, q: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """Places at similarity ``least`` or more; beams full of them are doubled."""
        out: list[np.ndarray] = [None] * len(q)  # type: ignore[list-item]
        rows = np.arange(len(q))
        while len(rows):
            beam = min(beam, len(self.v))
            ids, sims = self.nearest(q[rows], beam)
            hit = (sims >= least) & (ids >= 0)
            full = hit.all(axis=1) & (beam < len(self.v))
            for i, own, found in zip(rows[~full], ids[~full], hit[~full]):
                out[i] = own[found]
            rows, beam = rows[full], 2 * beam
        return out


def _unit(vectors: list) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in vectors])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def audited_beam(graph: Graph, exact: np.ndarray, q: np.ndarray, own: np.ndarray, least: float) -> int:
    """The first beam whose audit passes, or 0; ``own``: places of ``q`` itself (-1: not there), which do not count."""
    n = len(exact)
    audit = np.unique(np.linspace(0, len(q) - 1, min(len(q), max(AUDITS, len(q) // AUDIT_SHARE))).astype(int))
    near, linked = [], []
    for part in np.array_split(audit, -(-len(audit) * n * 8 // AUDIT_BYTES)):
        sims = q[part] @ exact.T
        here = own[part] >= 0
        sims[here, own[part][here]] = -2
        k = min(NEAREST, n)
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near += [row[s[row] > -2] for row, s in zip(best, sims)]
        linked += [np.flatnonzero(s >= least) for s in sims]
    q32, beam = q[audit].astype(np.float32), BEAM
    wanted, links = sum(map(len, near)), sum(map(len, linked))
    while beam <= WIDEST and beam < n:
        ids, _ = graph.nearest(q32, beam)
        met = sum(int(np.isin(x, y).sum()) for x, y in zip(near, ids))
        if wanted and met >= RECALL * wanted:
            found = graph.within(q32, least - 1e-4, beam)
            if sum(int(np.isin(x, y).sum()) for x, y in zip(linked, found)) >= RECALL * links:
                return beam
        beam *= 2
    return 0


def links_in(graph: Graph, exact: np.ndarray, q: np.ndarray, least: float, own: np.ndarray | None = None) -> list[np.ndarray]:
    """Verified links of unit vectors ``q`` (double) to the graph's vectors."""
    beam = audited_beam(graph, exact, q, np.full(len(q), -1) if own is None else own, least)
    if beam:
        found = graph.within(q.astype(np.float32), least - 1e-4, beam)
    else:
        rows = max(1, AUDIT_BYTES // (8 * len(exact)))
        found = [np.flatnonzero(s >= least - 1e-4) for i in range(0, len(q), rows) for s in q[i:i + rows] @ exact.T]
    return [ids[np.einsum("jd,d->j", exact[ids], v) >= least] for ids, v in zip(found, q)]


def near_duplicates(embeddings: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per vector."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    sound = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0), F.lit(False))
    nodes, _ = written(rows.where(sound).groupBy("embedding").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    n_nodes, n_bytes = nodes.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding").cast("long") * 8), F.lit(0))).first()
    shards = max(SHARDS, -(-n_bytes // SHARD_BYTES))
    dim = F.size("embedding").cast("long")
    nodes = nodes.withColumn("node", F.xxhash64("embedding")).withColumn(
        "shard", dim * shards + F.pmod("node", F.lit(shards)))
    folder = new_folder(spark, "graphs")

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable")
        exact = _unit(part["embedding"].tolist())
        graph = Graph.build(exact.astype(np.float32))
        held = io.BytesIO()
        np.savez(held, exact=exact, rep=part["rep"].fillna(-1).to_numpy(np.int64), node=part["node"].to_numpy(np.int64),
                 copies=part["copies"].to_numpy(np.int64), **{f"layer{h}": x for h, x in enumerate(graph.layers)})
        store, top = _at(folder)
        store.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"
        with store.open_output_stream(f"{top}/{name}", compression=None) as out:
            out.write(held.getvalue())
        return pd.DataFrame({"shard": [key[0]], "path": [f"{folder}/{name}"]})

    graphs, _ = written(nodes.groupBy("shard").applyInPandas(build, "shard long, path string"), "graphs")
    blocks = max(1, -(-n_nodes // QUERY_ROWS))
    tasks = min(blocks * shards, TASKS_A_SLOT * spark.sparkContext.defaultParallelism)
    asked = nodes.select("node", "embedding", F.explode(F.sequence(
        dim * shards, dim * shards + shards - 1)).alias("shard")).join(graphs, "shard")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks))).repartition(
        max(tasks, 1), "shard", "block").sortWithinPartitions("shard").select("path", "node", "embedding")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, graph, held = None, None, None
        for batch in batches:
            paths = batch.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(paths)) if paths[i] != paths[i - 1]), len(paths)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if paths[a] != name:
                    name = paths[a]
                    store, where = _at(name)
                    with store.open_input_file(where) as f:
                        held = dict(np.load(io.BytesIO(f.read())))
                    graph = Graph(held["exact"].astype(np.float32),
                                  [held[f"layer{h}"] for h in range(sum(k.startswith("layer") for k in held))], 0)
                node = batch.column(1).slice(a, b - a).to_numpy()
                known = {v: i for i, v in enumerate(held["node"].tolist())}
                name_of = np.concatenate([held["node"], node])
                at = np.array([known.get(v, len(known) + i) for i, v in enumerate(node.tolist())])
                found = links_in(graph, held["exact"], _unit(batch.column(2).slice(a, b - a).to_pylist()), least,
                                 np.where(at < len(known), at, -1))
                forest, count = Forest(len(name_of)), np.zeros(len(node), np.int64)
                for i, own in enumerate(found):
                    own = own[own != at[i]]
                    count[i] = held["copies"][own].sum()
                size = np.array([len(own) for own in found])
                if size.sum():
                    forest.join(np.repeat(at, size), np.concatenate(found))
                tree = np.flatnonzero(forest.label != np.arange(len(name_of)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node, name_of[tree]])),
                     pa.array([None] * len(node) + name_of[forest.label[tree]].tolist(), pa.int64()),
                     pa.array(np.concatenate([count, np.zeros(len(tree), np.int64)]))], ["a", "b", "n"])

    found, _ = written(asked.mapInArrow(ask, "a long, b long, n long"), "vector-links")
    united = components(found.select("a", "b"))
    counted = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    labelled = nodes.join(counted, "node", "left").join(united, "node", "left").select(
        "embedding", "rep", "copies", "n", F.coalesce("component", "node").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = labelled.join(smallest, "component").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return rows.join(classes, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: Every pair compared; the whole SQL, as the query, is exact at these sizes.
ORACLE = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)
    and list_contains(list_transform(embedding, lambda x: x <> 0), true)),
l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) as n_links from l group by a),
c as (select a, min(b) as low from r group by a)
select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
"""
