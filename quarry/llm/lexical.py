"""Ranked lexical search: best-first document intervals under range-maximum bounds.

Index: the tasks that read the documents put about BLOCK of them into a block, by ascending id, and write for each
term of the items a posting list (places in the block, occurrences). Which terms are kept is decided by a filter of fixed size
that lets all of the items' terms through (see bitset); others that pass go by an exact join.

Search: a block's postings become impacts, one array for all lists, with a sparse table of the places of range maxima over it. An item
begins with the whole block as one interval. The bound of an interval is the sum over the item's terms of their greatest impacts in it. The
intervals of the highest bounds are taken first: each is split at the document of its greatest single impact, which is scored, into what is left and right
of it; intervals of LEAF postings or fewer are scored outright. An interval goes when its bound is less than the k-th best score, or equal and all of its
documents come later. So each block gives its exact best k, and the best k of all blocks are the result, with ties by id.

Rows: null texts and texts without a term count for nothing. A null doc_id ranks last among equal scores. Repeated documents are
documents of their own; repeated items (id and text) count once, and items that share an id but not a text are ranked apart. Items
without a known term have no row. Extra columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.bitset import BITS, bitset, passes
from quarry.llm.scratch import Scratch
from quarry.llm.shards import answered
from quarry.llm.words import but, distinct, lists, lowered, raw, slices, spread, split, strings

#: Documents, and postings, that close a block.
BLOCK, POSTINGS = 1 << 13, 1 << 20
LEAF, TAKEN = 64, 64
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = but((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_LISTS = "part int, run int, term string, at array<long>, counts array<int>"


class _Open:
    """A block that is being filled."""

    def __init__(self):
        self.ids, self.sizes, self.hashes, self.docs, self.tfs, self.names = [], [], [], [], [], {}
        self.n = self.postings = 0

    def add(self, ids: list, w, bits: np.ndarray) -> None:
        hashes, doc = w.hashes(), w.doc
        some = np.flatnonzero(passes(hashes, bits))
        codes, first = distinct(hashes[some])
        for h, name in zip(hashes[some[first]].tolist(), strings(w, some[first]).to_pylist(), strict=True):
            self.names.setdefault(h, name)
        pair, tf = np.unique(doc[some] * max(len(first), 1) + codes, return_counts=True)
        self.hashes.append(hashes[some[first]][pair % max(len(first), 1)])
        self.docs.append(pair // max(len(first), 1) + self.n)
        self.tfs.append(tf)
        self.ids += ids
        self.sizes.append(w.counts)
        self.n, self.postings = self.n + len(ids), self.postings + len(pair)

    def rows(self, part: int, run: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(self.n), key=lambda i: (self.ids[i] is None, self.ids[i]) if self.ids[i] is not None else (True, 0))
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        sizes, hashes, docs, tfs = (np.concatenate(x) for x in (self.sizes, self.hashes, self.docs, self.tfs))
        docs = place[docs]
        sort = np.lexsort((docs, hashes))
        hashes, docs, tfs = hashes[sort], docs[sort], tfs[sort]
        cuts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
        at = [pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())), *(lists(p, pa.int64()) for p in [np.split(docs, cuts[1:])] if len(cuts))]
        counts = [lists([sizes[order]], pa.int32()), *(lists(p, pa.int32()) for p in [np.split(tfs, cuts[1:])] if len(cuts))]
        for a, c, names in zip(at, counts, ([None], [self.names[h] for h in hashes[cuts].tolist()]), strict=False):
            yield pa.record_batch([pa.array([part] * len(a), pa.int32()), pa.array([run] * len(a), pa.int32()), pa.array(names, pa.string()), a, c], names=["part", "run", "term", "at", "counts"])


def posting_lists(docs: DataFrame, terms: Broadcast, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """part, run (together the block), term, at, counts: a posting list for each term that passes, and a row without a term for the block's ids and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now = TaskContext.get().partitionId(), 0, _Open()
        for some in slices(batches, "text"):
            for a in range(0, some.num_rows, block):
                piece = some.slice(a, block)
                data, offsets = raw(piece.column("text"))
                now.add(piece.column("id").to_pylist(), split(lowered(data), offsets, _TERM), terms.value)
                if now.n >= block or now.postings >= POSTINGS:
                    yield from now.rows(part, number)
                    number, now = number + 1, _Open()
        if now.n:
            yield from now.rows(part, number)

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, _LISTS)


def _hashes(terms: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"key": pa.array(split(*raw(batch.column("term")), _TERM).hashes().view(np.int64))})

    return terms.mapInArrow(run, "key long")


class Block:
    """Impacts of a block's postings with a sparse table of range maxima."""

    def __init__(self, table: pa.Table, n_docs: int, n_terms: int):
        table = table.combine_chunks()
        names, at, counts, weight = table["term"].to_pylist(), table["at"].combine_chunks(), table["counts"].combine_chunks(), table["w"].to_numpy()[1:]
        size = np.array(at.value_lengths(), np.int64)
        flat, tf = at.flatten(), counts.flatten().to_numpy().astype(np.int64)
        self.ids, n = flat.slice(0, size[0]).to_pylist(), tf[: size[0]]
        self.docs, tf, size = flat.slice(size[0]).to_numpy(), tf[size[0] :], size[1:]
        self.number = {t: i for i, t in enumerate(names[1:])}
        self.offsets = np.r_[0, np.cumsum(size)]
        wide = n.astype(object) if 75 * int(n.max(initial=0)) * n_docs >= 1 << 63 else n
        m = (25 + 75 * wide * n_docs // max(n_terms, 1)).astype(np.int64)
        self.impact = np.repeat(weight, size) * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs]))
        self.keys = np.repeat(np.arange(len(size)), size) * len(self.ids) + self.docs
        self.best = [np.arange(len(tf), dtype=np.int32)]
        for j in range(int(size.max(initial=1)).bit_length() - 1):
            left, right = self.best[j][: -(1 << j)], self.best[j][1 << j :]
            self.best.append(np.where(self.impact[left] >= self.impact[right], left, right))
        self.starts = np.r_[0, np.cumsum([len(b) for b in self.best])]
        self.flat = np.concatenate(self.best)

    def maxima(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest impact in postings low to high (exclusive), 0 where there is none, and its leftmost place."""
        size = high - low
        j = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        some = size > 0
        a = self.flat[np.where(some, self.starts[j] + low, 0)]
        b = self.flat[np.where(some, self.starts[j] + high - (1 << j), 0)]
        place = np.where(self.impact[a] >= self.impact[b], a, b)
        return np.where(some, self.impact[place], 0), place

    def search(self, terms: list[str], k: int) -> list[tuple[int, int]]:
        """The k best (score, place in the block) above 0, best first."""
        count = Counter(self.number[t] for t in terms if t in self.number)
        if not count:
            return []
        t, q, d = np.array(list(count)), np.array(list(count.values()), np.int64), len(self.ids)
        low, high, begin, end = self.offsets[t][None], self.offsets[t + 1][None], np.zeros(1, np.int64), np.full(1, d)
        value, place = self.maxima(low, high)
        bound = value @ q
        scores, where = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(bound):
            order = np.lexsort((begin, -bound))
            now, later = order[:TAKEN], order[TAKEN:]
            small = (high[now] - low[now]).sum(axis=1) <= LEAF
            leaf, wide = now[small], now[~small]
            # leaves: all of their documents
            size = (high[leaf] - low[leaf]).ravel()
            at = spread(low[leaf].ravel(), size)
            docs, back = np.unique(self.docs[at], return_inverse=True)
            total = np.zeros(len(docs), np.int64)
            np.add.at(total, back, self.impact[at] * np.repeat(np.tile(q, len(leaf)), size))
            # others: the document of the greatest impact, and both sides of it
            top = np.argmax(value[wide] * q, axis=1)
            doc = self.docs[place[wide, top]]
            middle = np.searchsorted(self.keys, t[None] * d + doc[:, None])
            there = self.keys[np.minimum(middle, len(self.keys) - 1)] == t[None] * d + doc[:, None]
            own = np.where(there, self.impact[np.minimum(middle, len(self.keys) - 1)], 0) @ q
            scores, where = np.r_[scores, total, own], np.r_[where, docs, doc]
            best = np.lexsort((where, -scores))[:k]
            scores, where = scores[best], where[best]
            low_, high_ = np.vstack([low[wide], middle + there]), np.vstack([middle, high[wide]])
            value_, place_ = self.maxima(low_, high_)
            low, high, value, place = (np.vstack([x[later], y]) for x, y in ((low, low_), (high, high_), (value, value_), (place, place_)))
            begin, end, bound = np.r_[begin[later], begin[wide], doc + 1], np.r_[end[later], doc, end[wide]], np.r_[bound[later], value_ @ q]
            open_ = bound > 0
            if len(scores) == k:
                open_ &= (bound > scores[-1]) | (bound == scores[-1]) & (begin < where[-1])
            low, high, value, place, begin, end, bound = (x[open_] for x in (low, high, value, place, begin, end, bound))
        return [(s, w) for s, w in zip(scores.tolist(), where.tolist(), strict=True) if s > 0]


def rank(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """item_id, key (of the item's text), rank, doc_id, score: the k best documents of each item."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms"))
    asked = scratch.table(asked.where(F.size("terms") > 0).dropDuplicates(["item_id", "key", "terms"]), "items")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    found = scratch.table(posting_lists(docs, bitset(_hashes(terms), bits), doc_id, text, block), "postings")
    sizes = found.where("term is null").agg(
        F.sum(F.size(F.filter("counts", lambda n: n > 0))), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)), F.max("part"), F.max("run"),
    ).first()
    n_docs, n_terms, parts, runs = (x or 0 for x in sizes)
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    weights = found.where("term is not null").groupBy("term").agg(F.sum(F.size("at")).alias("df")).join(terms, "term", "left_semi").select("term", weight.cast("long").alias("w")).where("w > 0")
    index = found.where("term is not null").join(weights, "term").unionByName(found.where("term is null").withColumn("w", F.lit(0).cast("long")))
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    queries = asked.withColumn("part", steps(parts)).withColumn("run", steps(runs))

    def solve(shard: Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for item, key, words in zip(*[part.column(c).to_pylist() for c in ("item_id", "key", "terms")], strict=True):
            out += [(item, key, shard.ids[at], score) for score, at in shard.search(words, k)]
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["item_id", "key", "doc_id", "score"])

    best = answered(index, queries, ["part", "run"], "term", lambda t: Block(t, n_docs, n_terms), solve, "item_id long, key long, doc_id long, score long", max((parts + 1) * (runs + 1), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    place = F.row_number().over(Window.partitionBy("item_id", "key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "key", F.col("rank").cast("int"), "doc_id", "score")
