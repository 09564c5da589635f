"""Lexical ranking and nearest neighbours against brute force, with edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import lexical, neighbours

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(UPPER))


def ranked(docs, items, k):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    n_docs, total = len(tf), sum(n for _, _, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    out = set()
    for item, text in set(items):
        scores = []
        for i, c, n in tf:
            m = 25 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            scores += [(-s, i is None, i or 0)] if s > 0 else []
        out |= {(item, text, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 120), p=p / p.sum()))) for i in rng.permutation(1200)]
    docs += [(5000 + i, "Many EQUAL copies, of w390 and w391!") for i in range(150)]
    docs += [(7, "w1 w2"), (None, "w399 w398 w1"), (9000, None), (9001, ""), (9002, " -- "), (9003, "é字 w399 x")]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 30), p=p / p.sum()))) for i in range(25)]
    return docs, [*items, (100, "equal copies w390"), (101, "W399 w399 é字"), (102, "nowhere"), (103, None), (104, ""), (3, "w5 w9"), (0, items[0][1])]


@pytest.mark.parametrize(("block", "k", "bits"), [(100, 10, lexical.BITS), (8192, 10, lexical.BITS), (64, 3, 64)])
def test_ranks_equal_brute_force(spark, corpus, block, k, bits):
    docs, items = corpus
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"term": F.lit("w1"), "part": F.lit(3), "id": F.lit(1)}).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    text = {(i, r.key): t for i, t in items for r in spark.createDataFrame([(t or "",)], "t string").select(F.xxhash64("t").alias("key")).collect()} if block == 100 else None
    got = lexical.rank(table, asked, k=k, block=block, bits=bits).collect()
    want = ranked(docs, items, k)
    if text:
        assert {(r.item_id, text[r.item_id, r.key], r["rank"], r.doc_id, r.score) for r in got} == want
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == Counter((w[0], *w[2:]) for w in want)


def test_intervals_are_pruned(spark, corpus, monkeypatch):
    """The bounds leave out most documents of a block for an item that a few documents match best."""
    import pyarrow as pa

    n = 4000
    rare = np.arange(0, n, 400)
    at = [list(range(n)), rare.tolist()]
    table = pa.table({"term": [None, "common", "rare"], "at": pa.array([list(range(n)), *at], pa.list_(pa.int64())), "counts": pa.array([[50] * n, [1] * n, [3] * len(rare)], pa.list_(pa.int32())), "w": pa.array([0, 5, 6000], pa.int64())})
    block, seen = lexical.Block(table, n, 50 * n), []
    find = block.maxima
    monkeypatch.setattr(block, "maxima", lambda low, high: seen.append(len(low)) or find(low, high))
    found = block.search(["rare", "common"], 10)
    assert [at for _, at in found] == rare.tolist()
    assert sum(seen) < 100


def test_lexical_without_rows(spark, corpus):
    docs, items = (spark.createDataFrame(t, s) for t, s in zip(corpus, ("doc_id long, text string", "item_id long, text string"), strict=True))
    assert lexical.rank(docs.limit(0), items).count() == 0 and lexical.rank(docs, items.limit(0)).count() == 0


def nearest(rows, k, queries):
    """{(query_id, vector): [(vec_id, score)]} of distinct rows that take part."""
    sound = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in sound:
        if queries(i):
            a = np.array(v)
            found = []
            for j, u in sound:
                if (j, u) != (i, v) and len(u) == len(v):
                    b = np.array(u)
                    found.append((-float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), j))
            out.setdefault(i, []).append([(j, -s) for s, j in sorted(found)[:k]])
    return out


@pytest.mark.parametrize("shard", [300, 1 << 14])
def test_recall(spark, shard):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 48))
    rows = [(i, (centres[i % 40] + 0.7 * rng.normal(size=48)).astype(np.float32).tolist()) for i in range(2500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(neighbours.build_index(table, shard=shard), table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = nearest(rows, 5, lambda i: i % 50 == 0)
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q][0]}) for q in want)
    assert hits >= 0.97 * 5 * len(want)
    exact = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert [(s, v) for _, v, s in sorted(found)] == sorted(((s, v) for _, v, s in found), key=lambda x: (-x[0], x[1]))
        for _, v, s in found:
            assert abs(s - exact[q] @ exact[v] / math.sqrt((exact[q] @ exact[q]) * (exact[v] @ exact[v]))) < 1e-12


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 0.0]), (50, [1e300, 1e300]), (7, [1e-300, 0.0]), (8, [1.0, 2.0, 3.0]), (100, [3.0, 2.0, 1.0]), (9, [-1.0, 0.0])]
    rows += [(i, [2.0, 2.0]) for i in range(150, 190)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "shard": F.lit(9), "score": F.lit(0)})
    got = {}
    for r in neighbours.search(neighbours.build_index(table), table.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert sorted(got[50]) == [(i + 1, 150 + i, 1.0) for i in range(5)]
    assert sorted(got[150]) == [(1, 50, 1.0), *[(i + 1, 150 + i, 1.0) for i in range(1, 5)]]
    assert sorted(got[100]) == [(1, 8, round(10 / 14, 9))]
    half = round(math.sqrt(0.5), 9)
    assert sorted(got[0]) == sorted([(1, 7, 1.0), (2, 50, half), (3, 150, half), (4, 151, half), (5, 152, half), (1, 50, half), (2, 150, half), (3, 151, half), (4, 152, half), (5, 153, half)])
    assert neighbours.search(neighbours.build_index(table.limit(0)), table.limit(0)).count() == 0


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    got = neighbours.search(neighbours.build_index(table), table.where("vec_id = 0")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, -1.0)]
