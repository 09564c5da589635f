"""Approximate nearest neighbours: a hierarchical navigable small-world graph to each shard.

Index: every vector counts once, with its smallest ids; equal vectors are equally near, so that further ids of one vector cannot be among the
first k. Vectors are dealt to shards by hash; a shard has about SHARD of them. Each shard's graph has a row for each node: its
vector and its flat neighbour arrays, of 2 * LINKS places on the lowest layer and LINKS on each upper one (-1 where free). Nodes are
numbered so that an upper layer is the first so many of the layer below.

A shard's layers are built from the top. Nodes come in batches: all of one batch descend side by side to their beam of near nodes, compare with
the batch's own, keep LINKS that are nearer to them than to each other, and are linked back; a full node chooses anew.

Search: each query asks each shard of its dimension; the shards' beams give candidates, whose cosines are computed in double
precision from the original vectors, and the best of all shards are the result.

Rows: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id. Repeated rows (id and
vector) count once; rows that share an id but not a vector are apart. Vectors of other dimensions are no candidates. Extra columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.scratch import Scratch
from quarry.llm.shards import answered, matrix
from quarry.llm.words import lists

#: Vectors and components of a shard, about.
SHARD, COMPONENTS = 1 << 14, 1 << 23
LINKS, BUILD_BEAM, BEAM, UPPER_BEAM, BATCH, STEP = 16, 64, 128, 8, 256, 4
LAYERS = 6
_PART = "dim int, shard long, node int, ids array<long>, layer int, links array<int>, upper array<int>, vector "


def taking_part(vector: Column) -> Column:
    """If a vector has a direction."""
    x = vector.cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(sound & F.exists(x, lambda v: v != 0), F.lit(False))


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, each scaled by a power of two so that squares neither overflow nor vanish, and their lengths."""
    x = vectors.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of each query's `width` best nodes that a walk along links finds, best first; -1 where there are fewer. start: distinct nodes for each query."""
    b, degree = len(queries), links.shape[1]
    width = max(width, start.shape[1], STEP)
    nodes, sims, done, seen = np.full((b, width), -1), np.full((b, width), -np.inf, np.float32), np.ones((b, width), bool), np.zeros((b, len(vectors)), bool)
    r, c = np.nonzero(start >= 0)
    nodes[r, c], sims[r, c], done[r, c], seen[r, start[r, c]] = start[r, c], np.einsum("ij,ij->i", vectors[start[r, c]], queries[r]), False, True
    live = np.arange(b)
    while len(live):
        waiting = np.where(done[live], -np.inf, sims[live])
        pick = np.argpartition(-waiting, STEP - 1, axis=1)[:, :STEP]
        good = np.take_along_axis(waiting, pick, 1) > -np.inf
        go = good.any(axis=1)
        live, pick, good = live[go], pick[go], good[go]
        if not len(live):
            break
        done[live[:, None], pick] = True
        near = np.where(good[:, :, None], links[nodes[live[:, None], pick]], -1).reshape(len(live), STEP * degree)
        near.sort(axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[live[:, None], near]
        r, c = np.nonzero(fresh)
        flat = near[r, c]
        seen[live[r], flat] = True
        more = np.full(near.shape, -np.inf, np.float32)
        more[r, c] = np.einsum("ij,ij->i", vectors[flat], queries[live[r]])
        all_sims, all_nodes, all_done = np.hstack([sims[live], more]), np.hstack([nodes[live], np.where(fresh, near, -1)]), np.hstack([done[live], ~fresh])
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live], nodes[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_sims, all_nodes, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)


def _choose(vectors: np.ndarray, found: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each row `most` of the nodes found: from the nearest on those that are nearer to the row's own vector than to any chosen one, then the nearest of the others."""
    out = np.full((len(found), most), -1, np.int32)
    step = max(1, 4_000_000 // (found.shape[1] * max(found.shape[1], vectors.shape[1])))
    for a in range(0, len(found), step):
        order = np.argsort(-sims[a : a + step], axis=1, kind="stable")
        node, sim = np.take_along_axis(found[a : a + step], order, 1), np.take_along_axis(sims[a : a + step], order, 1)
        own = vectors[node]
        cross = own @ own.transpose(0, 2, 1)
        kept, nearest = np.zeros(node.shape, bool), np.full(node.shape, -np.inf, np.float32)
        for j in range(node.shape[1]):
            ok = (node[:, j] >= 0) & (sim[:, j] > nearest[:, j]) & (kept.sum(axis=1) < most)
            kept[ok, j] = True
            nearest[ok] = np.maximum(nearest[ok], cross[ok, j])
        others = (node >= 0) & ~kept
        kept |= others & (np.cumsum(others, axis=1) <= most - kept.sum(axis=1)[:, None])
        place = np.argsort(~kept, axis=1, kind="stable")[:, :most]
        part = np.where(np.take_along_axis(kept, place, 1), np.take_along_axis(node, place, 1), -1)
        out[a : a + step, : part.shape[1]] = part
    return out


def _link_back(vectors: np.ndarray, links: np.ndarray, used: np.ndarray, new: np.ndarray) -> None:
    """Links from the chosen nodes of each new node back to it."""
    degree = links.shape[1]
    r, c = np.nonzero(links[new] >= 0)
    at, to = links[new][r, c], new[r]
    sims = np.einsum("ij,ij->i", vectors[at], vectors[to])
    order = np.lexsort((-sims, at))
    at, to = at[order], to[order]
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(at)])
    place = np.arange(len(at)) - np.repeat(begin, size)
    full = np.repeat(used[at[begin]] + size > degree, size)
    fits = ~full
    links[at[fits], used[at[fits]] + place[fits]] = to[fits]
    nodes = at[begin][used[at[begin]] + size > degree]
    if len(nodes):
        number = np.searchsorted(nodes, at[full])
        wide = np.full((len(nodes), 3 * degree), -1)
        wide[:, :degree] = links[nodes]
        ok = place[full] < 2 * degree  # the nearest come first, and a node keeps no more than degree
        wide[number[ok], degree + place[full][ok]] = to[full][ok]
        near = np.where(wide >= 0, np.einsum("ijk,ik->ij", vectors[wide], vectors[nodes]), -np.inf)
        links[nodes] = _choose(vectors, wide, near, degree)
    changed = at[begin]
    used[changed] = (links[changed] >= 0).sum(axis=1)


def _descend(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Where queries enter the layer below layers (from the top down)."""
    start = np.zeros((len(queries), 1), np.int64)
    for links in layers:
        start = beam(vectors[: len(links)], links, queries, start, UPPER_BEAM)[0][:, :UPPER_BEAM]
    return start


def build(vectors: np.ndarray, counts: list[int]) -> list[np.ndarray]:
    """Links of each layer, from the top. vectors: of length one, nodes of upper layers first; counts: of nodes by layer, from the top."""
    layers: list[np.ndarray] = []
    for n in counts:
        degree = 2 * LINKS if len(layers) == len(counts) - 1 else LINKS
        links, used = np.full((n, degree), -1, np.int32), np.zeros(n, np.int64)
        for a in range(0, n, BATCH):
            new = np.arange(a, min(a + BATCH, n))
            own = vectors[new] @ vectors[new].T
            np.fill_diagonal(own, -np.inf)
            top = np.argsort(-own, axis=1, kind="stable")[:, : min(len(new), 2 * LINKS)]
            sims, found = np.take_along_axis(own, top, 1), np.where(np.take_along_axis(own, top, 1) > -np.inf, new[top], -1)
            if a:
                nodes, near = beam(vectors[:a], links[:a], vectors[new], _descend(vectors, layers, vectors[new]) if layers and len(layers[-1]) <= a else np.zeros((len(new), 1), np.int64), BUILD_BEAM)
                found, sims = np.hstack([found, nodes]), np.hstack([sims, near])
            links[new, :LINKS] = _choose(vectors, found, sims, LINKS)
            used[new] = (links[new] >= 0).sum(axis=1)
            _link_back(vectors, links, used, new)
        layers.append(links)
    return layers


def distinct_vectors(vectors: DataFrame, k: int, vec_id: str, vector: str) -> DataFrame:
    """vector, ids: each vector once, with its k + 1 smallest ids."""
    kind = vectors.schema[vector].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & taking_part(F.col("vector"))).dropDuplicates(["id", "vector"])
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def build_index(vectors: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The graph table: dim, shard, node, ids, layer (its uppermost), links, upper (from the top layer on), vector; and shards, their number."""
    scratch = Scratch(vectors.sparkSession)
    once = scratch.table(distinct_vectors(vectors, k, vec_id, vector), "vectors")
    n, components = once.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    shards = max(1, -(-n // shard), -(-components // COMPONENTS))
    u = (F.pmod(F.xxhash64("vector", F.lit("layer")), F.lit(1 << 32)) + 1) / float(1 << 32)
    dealt = once.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("shard"), "ids", F.least(F.floor(-F.log(u) / float(np.log(LINKS))), F.lit(LAYERS)).cast("int").alias("layer"), F.xxhash64("vector", F.lit("order")).alias("order"), "vector")
    kind = once.schema["vector"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("layer", "descending"), ("order", "ascending")])
        layer = table["layer"].to_numpy()
        x, length = unit(matrix(table["vector"], table["dim"][0].as_py()))
        counts = [int((layer >= i).sum()) for i in range(int(layer[0]), -1, -1)]
        layers = build((x / length[:, None]).astype(np.float32), counts)
        upper = [np.concatenate([np.zeros(0, np.int32), *[y[i] for y in layers[:-1] if i < len(y)]]) for i in range(len(layer))]
        node = pa.array(np.arange(len(layer)), pa.int32())
        return pa.table({"dim": table["dim"], "shard": table["shard"], "node": node, "ids": table["ids"], "layer": table["layer"], "links": lists(list(layers[-1]), pa.int32()), "upper": lists(upper, pa.int32()), "vector": table["vector"]})

    # one task to a shard, whatever its bytes are: it is work that takes the time
    graph = dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(run, _PART + kind)
    return scratch.table(graph, "graph").withColumn("shards", F.lit(shards))


class Shard:
    """A shard's graph in memory."""

    def __init__(self, table: pa.Table):
        self.ids, self.vectors = table["ids"].to_pylist(), matrix(table["vector"], table["dim"][0].as_py())
        self.exact, self.length = unit(self.vectors)
        self.unit = (self.exact / self.length[:, None]).astype(np.float32)
        layer = table["layer"].to_numpy()
        self.layers = []
        flat, size = table["upper"].combine_chunks(), layer.astype(np.int64) * LINKS
        values, begin = flat.flatten().to_numpy(), np.cumsum(size) - size
        for i in range(int(layer.max()), 0, -1):
            n = int((layer >= i).sum())
            at = begin[:n] + (layer[:n] - i) * LINKS
            self.layers.append(values[at[:, None] + np.arange(LINKS)])
        self.layers.append(matrix(table["links"], 2 * LINKS))

    def nearest(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the `width` nearest nodes found for each query; -1 where there are fewer."""
        x, length = unit(queries)
        one = (x / length[:, None]).astype(np.float32)
        nodes = beam(self.unit, self.layers[-1], one, _descend(self.unit, self.layers[:-1], one), max(BEAM, width))[0][:, :width]
        return nodes, (self.exact[nodes] * x[:, None, :]).sum(axis=2) / (self.length[nodes] * length[:, None])


def search(index: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of queries, but itself. index: of build_index, for this k or a larger one."""
    spark = queries.sparkSession
    first = index.select("shards").first()
    shards = first[0] if first else 1
    kind = index.schema["vector"].dataType.simpleString()
    rows = queries.select(F.col(vec_id).cast("long").alias("query_id"), F.col(vector).cast(kind).alias("vector")).where(F.col("query_id").isNotNull() & taking_part(F.col("vector"))).dropDuplicates(["query_id", "vector"])
    asked = rows.select(F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "query_id", "vector")

    def solve(shard: Shard, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, part.num_rows, BATCH):
            some = part.slice(a, BATCH)
            own, ids = matrix(some.column("vector"), some.column("dim")[0].as_py()), some.column("query_id").to_pylist()
            nodes, cosines = shard.nearest(own, 2 * k + 6)
            out = []
            for i, query in enumerate(ids):
                found = [(-s, j, n) for n, s in zip(nodes[i].tolist(), cosines[i].tolist(), strict=True) if n >= 0 for j in shard.ids[n]]
                mine = [x for x in found if x[1] == query and np.array_equal(shard.vectors[x[2]], own[i])]
                out += [(query, i + a, j, -s) for s, j, _ in sorted(set(found) - set(mine))[:k]]
            hashes = some.column("key").to_pylist()
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([hashes[r[1] - a] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.float64())], names=["query_id", "key", "vec_id", "score"])

    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = answered(index.drop("shards"), asked.withColumn("key", F.xxhash64("vector")), ["dim", "shard"], "node", Shard, solve, "query_id long, key long, vec_id long, score double", parts)
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
