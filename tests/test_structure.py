"""Graphs, trees and nested texts against fixed values and brute force."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import brackets, spine, stats
from quarry.operators import fixpoint, memory, release, retrieval, trees


def one(spark, *columns, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(*columns).first()


def test_nested_binders(spark):
    """Types four brackets deep, two binders in one, default values and a colon inside of brackets."""
    s = "theorem t {R : Type*} (h : ¬ (((3:ℤ) + (a * (b))) ∣ y)) (k : f (g (h (i (j)))) = 1) (x y : ℕ) (d : ℕ := by exact (2 : ℕ)) (broken : ( : x = (if a then b else c) := by simp"
    r = one(spark, brackets.parts("s").alias("x"), s=s).x
    assert [(b.names, b.type) for b in r.binders][:5] == [(["R"], "Type*"), (["h"], "¬ (((3:ℤ) + (a * (b))) ∣ y)"), (["k"], "f (g (h (i (j)))) = 1"), (["x", "y"], "ℕ"), (["d"], "ℕ")]
    s = "lemma u.v' (h₀ : (x) + ((y)) = 2) [Fact p] (p : α) : (a : ℤ) ≤ b → c := by omega"
    row = one(spark, brackets.parts("s").alias("x"), "s", s=s)
    assert row.x.goal == "(a : ℤ) ≤ b → c" and row.x.head == "(h₀ : (x) + ((y)) = 2) [Fact p] (p : α)"
    found = spark.createDataFrame([(s,), ("theorem t (n : ℕ) : (∃ x, x > n → True)",), (None,), ("",)], ["s"]).withColumn("x", brackets.parts("s"))
    rows = found.select(brackets.hypotheses(F.col("x")).alias("h"), brackets.unconditional(F.col("x")).alias("u"), brackets.assumptions(F.col("x.binders")).alias("a"), brackets.without(F.col("s"), F.col("x"), F.array(F.lit("h₀"))).alias("w")).collect()
    assert [(h.name, h.type) for h in rows[0].h] == [("h₀", "x+y=2")] and rows[0].a == ["h₀"]
    assert [r.u for r in rows] == [False, True, False, False]
    assert rows[0].w == "theorem _probe [Fact p] (p : α) : (a : ℤ) ≤ b → c := by omega"


def test_very_deep_brackets(spark):
    deep = "theorem t (h : " + "(" * 20_000 + "x" + ")" * 20_000 + " = 1) : x = 1"
    r = one(spark, brackets.parts("s").alias("x"), s=deep).x
    assert len(r.binders) == 1 and r.binders[0].type.endswith(" = 1") and r.goal == "x = 1"


def test_changes_count_repeated_types(spark):
    p, c = "theorem a (h : x = 1) (g : y < (2)) : x = 1", "theorem b (h1 : x = 1) (h2 : x=1) (k : z ≤ 3) : x = 1"
    found = spark.createDataFrame([(p, c)], ["p", "c"]).select(brackets.parts("p").alias("p"), brackets.parts("c").alias("c")).select(brackets.hypotheses(F.col("p")).alias("p"), brackets.hypotheses(F.col("c")).alias("c"))
    r = found.select(brackets.changed(F.col("p"), F.col("c")).alias("d")).first().d
    assert (r.dropped, r.added) == (["g : y<2"], ["k : z≤3"])


def test_spine_and_coupling(spark):
    code = "theorem c : g := by\n  have a : P := by exact Foo.bar\n  have b : Q := by rw [a, nothing]\n  have side : S := by simp [b]\n  have loop : L := by simp [pool]\n  have pool : M := by simp [loop, b]\n  exact pool"
    parents = F.array(F.struct(F.lit("A").alias("key"), F.lit("P").alias("conclusion"), F.array(F.lit("Foo.bar")).alias("cited")), F.struct(F.lit("B").alias("key"), F.lit("M").alias("conclusion"), F.array(F.lit("Foo.bar")).alias("cited")))
    g = spark.createDataFrame([(code,), ("exact foo",), (None,)], ["code"]).withColumn("g", spine.steps(F.col("code"))).withColumn("r", spine.reach(F.col("g"))).withColumn("o", spine.owners(F.col("g"), parents))
    rows = g.select("g", "o", spine.spine(F.col("g"), spine.closing(F.col("code")), F.col("r")).alias("s"), spine.coupling(F.col("g"), F.col("r"), F.col("o")).alias("c")).collect()
    assert {x.name: x.uses for x in rows[0].g} == {"a": [], "b": ["a"], "side": ["b"], "loop": ["pool"], "pool": ["loop", "b"]}
    assert rows[0].s == ["L", "M", "P", "Q"] and rows[0].o == {"a": "A", "pool": "B"}
    assert (rows[0].c.depth, rows[0].c["at"]) == (1, "loop")
    assert [r.c.depth for r in rows[1:]] == [None, None] and [r.s for r in rows[1:]] == [[], []]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    kept, rounds = fixpoint.stored, []
    monkeypatch.setattr(fixpoint, "stored", lambda df: rounds.append(1) or kept(df))
    n = 10_000
    rows = spark.range(n).select("id", (F.col("id") - 1).alias("up"), (F.col("id") % 2500 == 7).alias("mark"))
    got = {r.id: (r.m, r.steps_m, r.cycle) for r in fixpoint.nearest(rows, "id", "up", m=F.col("mark")).collect()}
    assert len(rounds) <= 15 + 1
    assert len(got) == n and all(got[i] == ((i - 7) // 2500 * 2500 + 7 if i >= 7 else None, (i - 7) % 2500 if i >= 7 else None, False) for i in range(n))


def test_searches_end_at_their_marks(spark, monkeypatch):
    """A chain of 10,000 with a mark in four, and a cycle that has them: what lies above the marks is not looked at."""
    kept, rounds = fixpoint.stored, []
    monkeypatch.setattr(fixpoint, "stored", lambda df: rounds.append(1) or kept(df))
    rows = spark.range(10_000).select("id", (F.when(F.col("id") == 0, 3).otherwise(F.col("id") - 1)).alias("up"))
    got = {r.id: (r.a, r.b, r.steps_a, r.cycle) for r in fixpoint.nearest(rows, "id", "up", a=F.col("id") % 4 == 1, b=F.col("id") % 4 == 2).collect()}
    at = lambda i, r: next(j for j in (i, i - 1, i - 2, i - 3) if j % 4 == r) % (4 if i < 4 else 10_000)
    assert len(rounds) <= 4 and got == {i: (at(i, 1), at(i, 2), (i - 1) % 4, False) for i in range(10_000)}


def test_cycles_are_told(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 5), (5, 3), (6, 5), (7, 7), (8, 99)], "id long, up long")
    got = {r.id: (r.m, r.cycle) for r in fixpoint.nearest(rows, "id", "up", m=F.col("id") == 1).collect()}
    assert got == {1: (1, False), 2: (1, False), 8: (None, False), **{i: (None, True) for i in (3, 4, 5, 6, 7)}}
    new = {r.id: r.new for r in release.migrate_ids(rows, "id", "up", F.concat(F.lit("_m"), F.col("id").cast("string")), F.col("id") == 8).collect()}
    assert new == {1: "1", 2: "1_m2", 8: "8", **{i: None for i in (3, 4, 5, 6, 7)}}
    assert fixpoint.nearest(rows.limit(0), "id", "up", m=F.lit(True)).count() == 0


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "child long, ancestor long")
    up = edges.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("parent"))
    step = lambda now: now.join(up, "ancestor").select("child", F.col("parent").alias("ancestor"))
    got = {(r.child, r.ancestor) for r in fixpoint.until_empty(edges, step, ["child", "ancestor"]).collect()}
    assert got == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)}


def test_outcomes_go_to_open_entries(spark):
    log = spark.createDataFrame([("a", 10), ("a", 20), ("a", 30), ("b", 5), ("c", 1)], "k string, t long")
    outcomes = spark.createDataFrame([("a", 3, "too early"), ("a", 15, "x"), ("a", 16, "nothing open"), ("a", 35, "y"), ("b", 6, ""), ("b", 7, None), ("b", 8, "z"), ("d", 1, "no entry")], "k string, t long, outcome string")
    assert {(r.k, r.t): r.outcome for r in memory.resolved(log, outcomes, "k", "t").collect()} == {("a", 10): "x", ("a", 20): "y", ("a", 30): None, ("b", 5): "z", ("c", 1): None}


def test_outcomes_as_a_queue(spark):
    rng = random.Random(2)
    events = [(rng.choice("ab"), t, rng.random() < 0.5) for t in range(200)]
    want, queue = {}, {"a": [], "b": []}
    for k, t, put in events:
        if put:
            queue[k].append(t)
            want[k, t] = None
        elif queue[k]:
            want[k, queue[k].pop(0)] = t
    log, out = ([(k, t) for k, t, put in events if put is x] for x in (True, False))
    got = memory.resolved(spark.createDataFrame(log, "k string, t long"), spark.createDataFrame([(k, t, t) for k, t in out], "k string, t long, outcome long"), "k", "t")
    assert {(r.k, r.t): r.outcome for r in got.collect()} == want


def test_fields_with_content(spark):
    values = [0, 0.0, 0.5, -3, "", "x", "0", None, False, True, [], [[]], [None], {}, {"a": None}]
    rows, want = [], {}
    for i, (v, nest) in enumerate(itertools.product(values, (0, 1, 4))):
        tree = {"system_error": v, "other": [1, {"b": '"system_error": true'}]}
        for _ in range(nest):
            tree = {"x": [None, [tree]], "system_error": 0}
        rows.append((i, json.dumps(tree)))
        want[i] = bool(v)
    rows += [(900, None), (901, "no json"), (902, "[]"), (903, '{"a": "\\"system_error\\": true"}'), (904, '{"s\\u0079stem_error": 1}')]
    want |= {900: False, 901: False, 902: False, 903: False, 904: True}
    got = trees.names_with_content(spark.createDataFrame(rows, "id long, tree string"), "id", "tree", "system_error")
    assert {r.id: r.found for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_exact_signed_ranks(spark, n):
    ranks = range(1, n + 1)
    rows = [(n, s, n * (n + 1) // 2 - s) for s in range(n * (n + 1) // 2 + 1)]
    got = {r.plus: r.t for r in spark.createDataFrame(rows, "n long, plus long, minus long").select("plus", stats.signed_rank(F.col("n"), F.col("plus"), F.col("minus")).alias("t")).collect()}
    sums = [sum(c) for size in range(n + 1) for c in itertools.combinations(ranks, size)]
    for _, plus, minus in rows:
        assert got[plus].method == "exact" and abs(got[plus].p - min(1, 2 * sum(s <= min(plus, minus) for s in sums) / 2**n)) < 1e-12


def test_normal_signed_ranks(spark):
    r = one(spark, stats.signed_rank(F.col("n"), F.col("a"), F.col("b")).alias("t"), n=40, a=300, b=520).t
    z = (300 - 410) / math.sqrt(40 * 41 * 81 / 24)
    assert r.method == "normal" and abs(r.z - z) < 1e-12 and abs(r.p - math.erfc(abs(z) / math.sqrt(2))) < 1e-12
    r = one(spark, stats.signed_rank(F.col("n"), F.col("a"), F.col("b")).alias("t"), n=0, a=0, b=0).t
    assert (r.method, r.p) == ("none", 1.0)


@pytest.mark.parametrize("sounded", [0, 3, 200])
def test_token_joins_equal_all_pairs(spark, monkeypatch, sounded):
    monkeypatch.setattr(retrieval, "SOUNDED", sounded)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    sets = lambda n: [(i, sorted({words[min(int(rng.expovariate(0.15)), 39)] for _ in range(rng.randint(0, 12))})) for i in range(n)]
    queries, cards = sets(60), [*sets(25), (90, ["unknown"]), (91, [])]
    pairs = {(q, c): (len(set(x) & set(y)), len(set(x) & set(y)) / len(set(x) | set(y))) for q, x in queries for c, y in cards if set(x) & set(y)}
    q, c = (spark.createDataFrame(t, "id long, tokens array<string>") for t in (queries, cards))
    for least in (0.12, 0.5, 1.0):
        got = {(r["query"], r.card): (r.shared, r.score) for r in retrieval.token_pairs(q, c, least).collect()}
        assert got == {p: v for p, v in pairs.items() if v[1] >= least}
    want = {}
    for card, _ in cards:
        for rank, (s, query) in enumerate(sorted((-v[1], p[0]) for p, v in pairs.items() if p[1] == card)[:3], 1):
            want[card, rank] = (query, -s)
    assert {(r.card, r["rank"]): (r["query"], r.score) for r in retrieval.token_topk(q, c, 3).collect()} == want


def test_records_without_some_tables(spark):
    from quarry.operators import record

    rows = spark.createDataFrame([(i, "said", "f", "c", "mutation", bool(i % 2), True, True, True) for i in range(4)], "id long, statement string, formal string, code string, variant string, strong1 boolean, keep1 boolean, strong2 boolean, keep2 boolean")
    rows = rows.withColumns({"certificate": F.lit(None).cast("struct<statement:boolean,proof:boolean,audited:boolean,allowed:boolean,axioms:array<string>>"), "vacuous": F.lit(None).cast("boolean"), "corpus": F.lit(None).cast("int"), "duplicate_of": F.lit(None).cast("long"), "preserved": F.lit(None).cast("boolean")})
    out = record.assembled(rows, "id", {"rewrites": spark.createDataFrame([(1, True, "new"), (2, False, "no"), (3, True, "")], "id long, ok boolean, after string")})
    got = {r.id: r for r in out.select("id", "statement", "before", record.checks().alias("c"), record.admission().alias("a")).collect()}
    assert {i: (r.statement, r.before) for i, r in got.items()} == {0: ("said", None), 1: ("new", "said"), 2: ("said", None), 3: ("said", None)}
    assert all(c.result == "not run" and not c.ran for r in got.values() for c in r.c.values()) and len(got[0].c) == 10
    assert {i: r.a.why for i, r in got.items()} == {0: record.WHY["weak"], 1: None, 2: record.WHY["weak"], 3: None}


def test_fields_below_a_thousand_levels(spark):
    """Spark's own parser refuses such trees."""
    deep = "[" * 1_500 + '{"system_error": 1}' + "]" * 1_500
    rows = spark.createDataFrame([(1, deep), (2, '{"system_error": 1, "system_error": 1}'), (3, '{"system_error": NaN}')], "id long, tree string")
    assert {r.id: r.found for r in trees.names_with_content(rows, "id", "tree", "system_error").collect()} == {1: True, 2: False, 3: False}
