"""Phrases against brute force, with streams cut inside of prefixes, and edge cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import collocations as c
from quarry.llm.scratch import Scratch

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=c.TOP):
    total, f = Counter(), {}
    for text, lang in rows:
        lang = lang or "und"
        f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f[lang].update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + m] for p in found for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * found[p] >= 80 * counts[p[i : i + m]]}
        scored = []
        for p, a in found.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]], k))
        for rank, (score, a, phrase, l, r, k) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, total[lang], -score, k))
    return out


def got(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score, r.cut) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words, gaps = ["a", "B", "ab", "cé", "d#", "the", "x\u0000y"], [" ", " ", " ", "\t ", ", ", "\n", ". ", "; "]
    out = []
    for _ in range(120):
        n = rng.integers(0, 60)
        out.append(("".join(rng.choice(words, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.15, 0.05]) + rng.choice(gaps) for _ in range(n)), [None, "en", "und", "de"][rng.integers(4)]))
    return [*out, (None, "en"), ("", None), (" \n .. ", "fr"), *[("in spite of the odds", "en")] * 12]


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (10, 5)])
def test_phrases_equal_brute_force(spark, rows, least, top):
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"f": F.lit(0), "phrase": F.lit("z"), "salt": F.lit(1)})
    assert got(c.collocations(docs, least=least, top=top)) == brute(rows, least, top)


def test_a_small_filter_loses_nothing(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert got(c.collocations(docs, least=3, bits=64)) == brute(rows, 3)


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_streams_cut_inside_of_prefixes(spark, rows, ranges):
    counts = Counter()
    for text, _ in rows:
        w = (text or "").split()
        counts.update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    phrases = spark.createDataFrame([("en", list(p), n) for p, n in counts.items()], "lang string, words array<string>, f long")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for back in (False, True):
            found = c.stream(phrases, Scratch(spark), "test", back).collect()
            assert len(found) == len(counts)
            longer = Counter()
            for p, n in counts.items():
                short = p[1:] if back else p[:-1]
                longer[short] = max(longer[short], n)
            for r in found:
                p = tuple(r.words)
                assert (r.f, r.longer or 0) == (counts[p], longer[p])
                assert r.parts == [counts[p[len(p) - i :] if back else p[:i]] for i in range(1, len(p))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_long_texts_are_cut_where_pieces_end(spark, monkeypatch):
    text = "one two three four five six seven, " * 300
    data = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(c, "SLICE", 50)
    blocks = [b.tobytes().decode() for b, _, _ in c._blocks(data, np.array([0, len(data)]))]
    assert "".join(blocks) == text and len(blocks) > 100
    assert all(b[0] == "," for b in blocks[1:])


def test_products_over_64_bits(spark, monkeypatch):
    big = 1 << 50
    phrases = spark.createDataFrame([("en", ["a"], 3 * big), ("en", ["b"], 2 * big), ("en", ["a", "b"], 2 * big - 1)], "lang string, words array<string>, f long")
    monkeypatch.setattr(c, "frequent_phrases", lambda *a: (phrases, spark.createDataFrame([("en", 9 * big)], "lang string, n long")))
    assert got(c.collocations(phrases)) == {("en", 1, "a b", 2 * big - 1, 3 * big, 2 * big, 9 * big, 2_000_000 * (2 * big - 1) // (5 * big), 1)}


def test_no_rows(spark):
    assert got(c.collocations(spark.createDataFrame([], "text string, lang string"))) == set()
