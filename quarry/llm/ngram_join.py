"""N-gram Jaccard join with a count-vector R-tree.

Every distinct shingle set is a point: its shingles are hashed into GROUPS groups and counted. The
overlap of two sets is at most the sum of the coordinate minima of their points, and of a point and a
tree node at most that of the point and the node's coordinate maxima; pairs whose bound is too low
never meet. Pairs that survive are verified on the shingle sets.

One tree over all points would have to be on one machine, and in so many dimensions its upper nodes
prune nothing. Points are therefore dealt to cells first, losing no pair: sets of Jaccard similarity t
share at least one of their n - ceil(t n) + 1 first shingles in any common order, so a cell is one such
shingle. The order puts shingles of many texts last, which keeps cells small. In a first round each
member of a cell is held only against the cell's leader. Cells whose members are then all in one
component are done; a group of thousands of near copies ends here, in linear work. Members of
different components are compared through an R-tree over their cell, or over pairs of chunks of it
if it is large. Links between different texts never get lost; only pairs that are already connected
are left out.

Rows: null text and text without a word give an empty set, linked with nothing. Repeated rows and equal
sets are linked. A null doc_id gets no component (null). Rows that share a doc_id but not a text count as
versions of one document. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.components import components
from quarry.llm.scratch import Scratch
from quarry.llm.words import lists, shingle_sets, slices

GROUPS = 256
#: Shingles that share at least this part of some slice's texts come last in the order; the most frequent HEAVY of them.
SHARE, HEAVY = 200, 100_000
#: Members of a cell, or of a chunk of a larger one, that are indexed in one tree.
CHUNK = 2_000
LEAF = 16
#: Smaller cells are compared pair by pair, without a tree. Shingle sets that one verifying step holds on either side.
SMALL, HELD = 32, 500


def enough(overlap, a, b, pct: int):
    """Whether 100 * overlap >= pct * union for sets of sizes a and b."""
    return 100 * overlap >= pct * (a + b - overlap)


def count_vector(shingles: np.ndarray) -> bytes:
    """Counts by group, a byte each; 255 stands for that or more."""
    return np.minimum(np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), 255).astype(np.uint8).tobytes()


def vectors(column: pd.Series) -> np.ndarray:
    """Count vectors as a matrix, with counts of 255 or more as infinite, so that bounds stay bounds."""
    found = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), GROUPS).astype(np.int32)
    found[found == 255] = 1 << 22
    return found


class CountVectorTree:
    """A packed R-tree over count vectors: points sorted by size, leaves of LEAF points, nodes that hold coordinate maxima and size ranges."""

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes, self.vectors = sizes[self.order], vectors[self.order]
        self.levels = []  # from the leaves up: least and greatest size, coordinate maxima
        low, high, most = self.sizes, self.sizes, self.vectors
        while len(low) > LEAF:
            cuts = np.arange(0, len(low), LEAF)
            low, high, most = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((low, high, most))

    def search(self, size: int, vector: np.ndarray, pct: int) -> np.ndarray:
        """Indexes of the points, of any size, that may have enough overlap with the given one."""
        at = np.arange(len(self.levels[-1][0]) if self.levels else len(self.sizes))
        for depth in range(len(self.levels) - 1, -1, -1):
            low, high, most = (x[at] for x in self.levels[depth])
            bound = np.minimum(np.minimum(most, vector).sum(1), high)
            fits = (100 * high >= pct * size) & (pct * low <= 100 * size) & enough(bound, np.maximum(low, bound), size, pct)
            at = (at[fits][:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < (len(self.levels[depth - 1][0]) if depth else len(self.sizes))]
        fits = enough(np.minimum(self.vectors[at], vector).sum(1), self.sizes[at], size, pct)
        return self.order[at[fits]]


def _heavy(docs: DataFrame, k: int) -> DataFrame:
    """Shingles that many texts share. One in at least 1/SHARE of all texts is in as many of some slice's, so none is missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            flat, n = np.unique(np.concatenate(shingle_sets(part.column("text"), k)), return_counts=True)
            often = n >= max(3, part.num_rows // SHARE)
            yield pa.record_batch({"shingle": pa.array(flat[often].view(np.int64)), "n": pa.array(n[often])})

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _sketches(docs: DataFrame, k: int, pct: int, heavy) -> DataFrame:
    """doc_id, n, sig (digest of the set), prefix (cells of the set), vec (its count vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = heavy.value
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), k)
            prefix, sigs, vecs = [], [], []
            for s in sets:
                n = max(0, len(s) - (-(-pct * len(s) // 100)) + 1) if len(s) else 0
                if len(late) and len(s):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    often = late[at] == s
                    if often.any():
                        last = s[often][np.argsort(rank[at[often]], kind="stable")]
                        prefix.append(np.concatenate([s[~often], last])[:n].view(np.int64))
                    else:
                        prefix.append(s[:n].view(np.int64))
                else:
                    prefix.append(s[:n].view(np.int64))
                sigs.append(hashlib.md5(s.tobytes()).digest())
                vecs.append(count_vector(s))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "sig": pa.array(sigs, pa.binary()), "prefix": lists(prefix, pa.int64()), "vec": pa.array(vecs, pa.binary())})

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, prefix array<long>, vec binary")


def _bounded(pairs: DataFrame, nodes: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) that the bound by count vectors leaves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                bound = np.minimum(vectors(f.vec_a), vectors(f.vec_b)).sum(1)
                yield f.loc[enough(np.minimum(bound, np.minimum(f.n_a, f.n_b)), f.n_a, f.n_b, pct), ["a", "b"]]

    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("vec").alias(f"vec_{side}")), side)
    return pairs.where(f"100 * least(n_a, n_b) >= {pct} * greatest(n_a, n_b)").mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, pct: int, scratch: Scratch) -> DataFrame:
    """Pairs whose shingle sets have enough overlap; sets are made again, for the texts in question only.

    Nodes are dealt to blocks of about HELD; a set travels once to each pair of blocks that needs it, not once to each pair of nodes.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.record_batch({"doc_id": part.column("doc_id"), "shingles": pa.array([s.tobytes() for s in shingle_sets(part.column("text"), k)], pa.binary())})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = None, {}
        for f in frames:
            found = []
            for i, j, a, b, shingles in zip(f.i, f.j, f.a, f.b, f.shingles, strict=True):
                if block != (i, j):
                    block, held = (i, j), {}
                if shingles is not None:
                    held.setdefault(a, []).append(np.frombuffer(shingles, np.uint64))
                elif any(enough(len(x) + len(y) - len(np.union1d(x, y)), len(x), len(y), pct) for x in held[a] for y in held[b]):
                    found.append((a, b))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    pairs = scratch.table(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    table = scratch.table(docs.join(nodes, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles binary").distinct(), "sets")
    blocks = table.count() // HELD + 1
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = pairs.select(F.when(block("a") <= block("b"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("p")).select("p.*")
    placed = placed.select(block("a").alias("i"), block("b").alias("j"), "a", "b")
    needed = placed.select("i", "j", F.explode(F.array("a", "b")).alias("a")).distinct().join(table.withColumnRenamed("doc_id", "a"), "a")
    rows = placed.withColumn("shingles", F.lit(None).cast("binary")).unionByName(needed.select("i", "j", "a", F.lit(0).cast("long").alias("b"), "shingles"))  # no null, which would turn ids into floats
    # sets come before the pairs of their blocks
    return rows.repartition("i", "j").sortWithinPartitions("i", "j", F.col("shingles").isNull()).mapInPandas(run, "a long, b long").distinct()


def _cell_pairs(members: DataFrame, nodes: DataFrame, pct: int) -> DataFrame:
    """Pairs of different components in one cell that its R-tree leaves. members: cell, node, component, size (of the cell).

    A cell of over CHUNK members is cut into chunks; each pair of chunks is a task's work of its own.
    """
    parts = F.ceil(F.col("size") / CHUNK).cast("int")
    chunked = (
        members.withColumn("chunk", F.pmod(F.xxhash64("node"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("cell", "node", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
        .join(nodes.select("node", "n", "vec"), "node")
    )

    def of_small(f: pd.DataFrame, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of all pairs in the cells of at most SMALL rows that begin at cuts."""
        size = np.diff(np.r_[cuts, len(f)])
        size, cuts = size[size <= SMALL], cuts[size <= SMALL]
        rows = np.repeat(cuts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        after = np.repeat(cuts + size, size) - rows - 1
        x = np.repeat(rows, after)
        return x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)

    def of_large(f: pd.DataFrame, vec: np.ndarray, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexes of the pairs in rows a to b that an R-tree over them finds."""
        size = f.n.to_numpy()[a:b]
        tree = CountVectorTree(size, vec[a:b])
        for q in range(b - a):
            hit = tree.search(size[q], vec[a + q], pct)
            hit = hit[hit > q]
            yield np.full(len(hit), a + q), a + hit

    def pairs(f: pd.DataFrame) -> pd.DataFrame:
        key = f[["cell", "i", "j"]].to_numpy()
        cuts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1]
        ends = np.r_[cuts[1:], len(f)]
        vec, size = vectors(f.vec), f.n.to_numpy()
        x, y = of_small(f, cuts)
        fits = 100 * np.minimum(size[x], size[y]) >= pct * np.maximum(size[x], size[y])
        x, y = x[fits], y[fits]
        large = [p for a, b in zip(cuts, ends, strict=True) if b - a > SMALL for p in of_large(f, vec, a, b)]
        x, y = (np.concatenate([v, *w]) for v, w in zip((x, y), zip(*large, strict=True) if large else ([], []), strict=True))
        node, comp, chunk = (f[c].to_numpy() for c in ("node", "component", "chunk"))
        apart = (f.i != f.j).to_numpy()
        fits = (comp[x] != comp[y]) & (~apart[x] | (chunk[x] != chunk[y])) & (node[x] != node[y])
        x, y = x[fits], y[fits]
        keep = [enough(np.minimum(np.minimum(vec[p], vec[q]).sum(1), np.minimum(size[p], size[q])), size[p], size[q], pct) for p, q in zip(np.array_split(x, len(x) // 4_000 + 1), np.array_split(y, len(y) // 4_000 + 1), strict=True)]
        x, y = x[np.concatenate(keep)], y[np.concatenate(keep)]
        return pd.DataFrame({"a": np.minimum(node[x], node[y]), "b": np.maximum(node[x], node[y])}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f, last in _with_end(frames):
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            end = len(f)
            if not last:  # the last cell may go on in the next frame
                same = (f[["cell", "i", "j"]] == f[["cell", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
                end = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            rest = f.iloc[end:]
            if end:
                yield pairs(f.iloc[:end].reset_index(drop=True))

    return chunked.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInPandas(run, "a long, b long").distinct()


def _with_end(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """The frames, each with whether it is the last."""
    held = None
    for f in frames:
        if held is not None:
            yield held, False
        held = f
    if held is not None:
        yield held, True


def ngram_jaccard_join(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, n_equal (rows with this very set).

    Rows link when 100 * |intersection| >= pct * |union| of their distinct k-word shingles.
    """
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    scratch = Scratch(spark)
    often = _heavy(docs, k).orderBy(F.desc("n"), "shingle").limit(HEAVY).toPandas()  # HEAVY rows at most
    often = often.sort_values("n", ignore_index=True).assign(rank=np.arange(len(often)))
    late = often.shingle.to_numpy(np.int64).view(np.uint64)
    by = np.argsort(late)
    heavy = spark.sparkContext.broadcast((late[by], often["rank"].to_numpy(np.int64)[by]))
    sketches = scratch.table(_sketches(docs, k, pct, heavy), "sketches")
    equal = scratch.table(sketches.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_equal")), "equal")
    own = sketches.join(equal.where("node is not null"), "sig").where("doc_id = node")
    nodes = scratch.table(own.groupBy("node", "sig", "n").agg(F.first("prefix").alias("prefix"), F.first("vec").alias("vec")), "nodes")

    cells = nodes.select("node", F.explode("prefix").alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.table(cells.join(shared, "cell"), "members")
    # the text that others were made from shares more of its cells, with more texts, than they do
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    leaders = members.join(central, "node").groupBy("cell").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    led = members.join(leaders, "cell").where("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    led = scratch.table(_bounded(led, nodes, pct), "led")
    links = scratch.table(_verified(led, docs, k, pct, scratch), "links")

    labels = components(links, scratch)
    # in a cell of two, the leader has met the other
    placed = members.where("size > 2").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_ = placed.join(mixed.select("cell"), "cell", "left_semi").select("cell", "node", "component", "size")
    more = scratch.table(_cell_pairs(open_, nodes, pct).join(led, ["a", "b"], "left_anti"), "more")
    links = links.unionByName(_verified(more, docs, k, pct, scratch))
    labels = scratch.table(components(links, scratch), "labels")
    scratch.drop("members", "sets", "led", "nodes", "stars", "more", "links", "pairs")
    return (
        sketches.select("doc_id", F.col("n").alias("n_shingles"), "sig")
        .join(equal, "sig", "left")
        .join(labels, "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))
    )


def keep_one(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """docs (doc_id, text, more) with one document of each group of near copies: the first by doc_id, nulls last, and text digest.

    A document is known by doc_id and text: rows that share an id but not a text are apart, and so are rows without an id; of rows
    that share both, the first by the other columns stays. Documents without a word are near copies of none.
    """
    scratch, names = Scratch(docs.sparkSession), docs.columns
    rows = docs.withColumn("__digest", F.coalesce(F.md5("text"), F.lit("none")))
    ids = scratch.table(rows.groupBy("doc_id", "__digest").agg(F.count("*").alias("n")), "ids")
    clash = scratch.table(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("__clash")), "clash")  # Spark broadcasts it if its file is small
    # ids that do not tell documents apart are replaced by numbers below 0
    stand_in = F.when(F.col("__clash") | F.col("doc_id").isNull(), -1 - F.shiftrightunsigned(F.xxhash64("doc_id", "__digest"), 1)).otherwise(F.col("doc_id").cast("long"))
    keyed = lambda df: df.join(clash, "doc_id", "left").withColumn("__key", stand_in)
    joined = ngram_jaccard_join(keyed(rows).select(F.col("__key").alias("doc_id"), "text"), k, pct)
    labels = joined.groupBy(F.col("doc_id").alias("__key")).agg(F.min("component_id").alias("component"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__digest")
    members = scratch.table(keyed(ids).join(labels, "__key").select("component", first.alias("document")), "members")
    best = members.groupBy("component").agg(F.min("document").alias("best"), F.count("*").alias("n")).where("n > 1")
    gone = members.join(best, "component").where("document <> best").select("document.doc_id", "document.__digest")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["__digest"] == b["__digest"])
    gone = scratch.table(gone, "gone")
    left = rows.join(gone, same(rows, gone), "left_anti")
    again = ids.where("n > 1").select("doc_id", "__digest")
    single, several = left.join(again, same(left, again), "left_anti"), left.join(again, same(left, again), "left_semi")
    once = several.groupBy("doc_id", "__digest").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
    return single.select(*names).unionByName(once)
