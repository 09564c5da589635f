"""Golden cases of functions, keep rules, sources and streams."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from quarry.functions import stats, text as tx
from quarry.operators import gates, keep, retrieval, scoring
from quarry.sources import files
from quarry.streaming import online


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


SAME = [
    ("theorem a (x : ℝ) (h : x > 0) : x ≠ 0 := by simp", "theorem b (y : ℝ) (k : y > 0) : y ≠ 0 := by linarith"),
    ("theorem a (n m : ℕ) : n + m = m + n", "theorem zz  (p q : ℕ) :\n p + q = q + p"),
    ("theorem a : ∀ x : ℕ, x = x -- note", "theorem a : ∀ y : ℕ, y = y"),
]
DIFFERENT = [("theorem a (x : ℝ) : x > 0", "theorem a (x : ℝ) : x < 0"), ("theorem a (x y : ℝ) : x > y", "theorem a (x y : ℝ) : y > x")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_renamed_statements_are_equal(spark, a, b):
    assert one(spark, tx.alpha_normal(F.lit(a))) == one(spark, tx.alpha_normal(F.lit(b)))


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_other_statements_are_not(spark, a, b):
    assert one(spark, tx.alpha_normal(F.lit(a))) != one(spark, tx.alpha_normal(F.lit(b)))


def test_empty_digests(spark):
    assert one(spark, tx.fingerprint(F.lit("  "))) == ""
    assert one(spark, tx.plain_digest(F.lit(""))).startswith("e3b0c442")


@pytest.mark.parametrize(("text", "want"), [("so \\boxed{3}", "3"), ("\\boxed{1} then \\boxed{\\frac{1}{2}}", "\\frac{1}{2}"), ("none", None), ("\\boxed{open", None)])
def test_boxed(spark, text, want):
    assert one(spark, tx.boxed_answer(F.lit(text))) == want


def test_last_match_of_first_pattern(spark):
    assert one(spark, tx.last_of(F.lit("answer 1, so 3, answer 2"), (r"answer (\d)", r"so (\d)"))) == "2"


def test_lineage_ids(spark):
    made = F.lit("seed1__x__seed2__mut.hard__0123abcd__mut__0123abce")
    assert one(spark, tx.roots_of(made)) == ["seed1", "seed2"]
    assert one(spark, tx.chain_of(made)) == ["mut"]


def test_wilson_and_newcombe(spark):
    low, high = stats.wilson(F.lit(5), F.lit(10))
    assert (round(one(spark, low), 3), round(one(spark, high), 3)) == (23.659, 76.341)
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 0.0)
    d, low, high = stats.newcombe(F.lit(56), F.lit(70), F.lit(48), F.lit(80))
    assert round(one(spark, d), 2) == 20.0 and round(one(spark, low), 1) == 5.2 and round(one(spark, high), 1) == 33.4


def test_mcnemar(spark):
    rows = spark.createDataFrame([(0, 0), (1, 5), (3, 3)], "b int, c int").select(stats.mcnemar_exact("b", "c").alias("p")).collect()
    assert [round(r.p, 4) for r in rows] == [1.0, 0.2188, 1.0]


def test_bootstrap_bounds(spark):
    """Of all rows passed, of none, of half: 1,000 draws lie about the normal bounds; no row gives no bounds."""
    rows = spark.createDataFrame([(10, 10), (0, 10), (500, 1000), (0, 0)], "k long, n long").select(stats.bootstrap_share("k", "n", 1_000, 42).alias("b")).select("b.*").collect()
    assert [tuple(r) for r in rows[:2]] == [(100.0, 100.0), (0.0, 0.0)] and tuple(rows[3]) == (None, None)
    assert abs(rows[2].low - (50 - 1.96 * 1.5811)) < 0.4 and abs(rows[2].high - (50 + 1.96 * 1.5811)) < 0.4
    (drop,) = spark.createDataFrame([(700, 1000, 600, 1000)], "a long, b long, c long, d long").select(stats.bootstrap_drop("a", "b", "c", "d").alias("b")).select("b.*").collect()
    spread = 196 * (0.7 * 0.3 / 1000 + 0.6 * 0.4 / 1000) ** 0.5
    assert drop.drop_pp == pytest.approx(10) and abs(drop.low - (10 - spread)) < 0.15 and abs(drop.high - (10 + spread)) < 0.15
    assert stats.bounds(np.arange(1000)[::-1]) == (25, 974)


def test_bootstrap_of_accuracies(spark):
    """Rows in thirds: bounds lie about those of the normal, other keys draw otherwise, an arm without rows has none."""
    v, c = [0.0, 1 / 3, 2 / 3, 1.0], [400, 300, 200, 100]
    rows = spark.createDataFrame([(1, v, c, [1.0], [10]), (2, v, c, [], []), (3, v, c, None, None), (4, v, c, v, c)], "k long, v array<double>, c array<long>, w array<double>, d array<long>")
    one, two = (F.col("v"), F.col("c")), (F.col("w"), F.col("d"))
    got = rows.select(stats.bootstrap_mean([one], F.col("k"), 4_000).alias("a"), stats.bootstrap_mean([one, two], F.col("k"), 4_000).alias("b")).collect()
    spread = 196 * (1 / 9 / 1000) ** 0.5
    assert all(r.a.mean == pytest.approx(100 / 3) and abs(r.a.low - (100 / 3 - spread)) < 0.25 and abs(r.a.high - (100 / 3 + spread)) < 0.25 for r in got)
    assert len({(r.a.low, r.a.high) for r in got}) > 1 and got[0].b.mean == pytest.approx(100 / 3 - 100) and got[1].b.mean is None and got[2].b.low is None
    assert got[3].b.mean == 0 and abs(got[3].b.high - spread * 2**0.5) < 0.4


def test_places_against_sorting(spark):
    from quarry.operators.ranking import places

    rows = [(g, None if i % 17 == 0 else (i * 7919) % 50, i) for g in "ab" for i in range(300)] + [("c", None, 1)]
    got = {(r.g, r.t): (r.place, r.size) for r in places(spark.createDataFrame(rows, "g string, v int, t int"), "g", "v", "t", 8).collect()}
    for g in "abc":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        own = [r for r in own if r[1] is not None] + [r for r in own if r[1] is None]
        assert {r[2]: (i, len(own)) for i, r in enumerate(own)} == {t: v for (x, t), v in got.items() if x == g}


def test_all_names_two_edits_apart_meet(spark):
    rng = np.random.default_rng(3)
    names = sorted({"".join(rng.choice(list("ab"), rng.integers(0, 9))) for _ in range(120)})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    df = spark.createDataFrame([(x,) for x in names], "x string")
    met = df.select(F.col("x").alias("a"), F.explode(tx.part_keys(F.col("x"))).alias("key")).join(df.select(F.col("x").alias("b"), F.explode(tx.probe_keys(F.col("x"))).alias("key")), "key")
    found = {(r.a, r.b) for r in met.select("a", "b").distinct().collect()}
    assert {(a, b) for a in names for b in names if edits(a, b) <= 2} <= found


def test_cosine_and_jaccard(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    assert one(spark, stats.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, stats.cosine(arr(0, 0), arr(1, 1))) == 0.0
    assert one(spark, stats.jaccard(arr(), arr())) == 0.0
    assert one(spark, stats.upper_median(arr(0, 1, 2, 3))) == 2.0


def test_keep_rules(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("a", 4, False), ("b", 5, None), ("b", 6, False), (None, 7, True), (None, 8, True)], "k string, o int, c boolean")
    ids = lambda d: sorted(r.o for r in d.collect())
    assert ids(keep.keep_first(df, ["k"], "o")) == [1, 5, 7, 8]
    assert ids(keep.keep_last(df, ["k"], "o")) == [4, 6, 7, 8]
    assert ids(keep.certified_over_first(df, ["k"], F.col("c"), "o")) == [3, 5, 7, 8]


def test_empty_fingerprints_are_no_duplicates(spark):
    df = spark.createDataFrame([("", 1), ("", 2), ("x", 3), ("x", 4)], "fp string, o int")
    assert sorted(r.o for r in keep.unique_fingerprints(df, "fp", "o").collect()) == [1, 2, 3]


def test_gates_keep_three_values(spark):
    null = F.lit(None).cast("boolean")
    assert one(spark, gates.first_reason(("a", null), ("b", F.lit(True)))) == "b"
    assert one(spark, gates.first_reason(("a", null))) is None
    yes = F.lit(True)
    assert one(spark, gates.certificate_level(yes, yes, null, yes, yes)) == "statement_checked"
    assert one(spark, gates.certificate_level(yes, yes, yes, null, yes)) == "proof_checked"
    assert one(spark, gates.certificate_level(yes, yes, yes, yes, yes)) == "reproducible"


def test_parity(spark):
    a = spark.createDataFrame([(1, "8", None, None)], "k int, budget string, steps string, prefill boolean")
    b = spark.createDataFrame([(1, "8", "3", False)], "k int, budget string, steps string, prefill boolean")
    got = {r.field: r.verdict for r in gates.parity(a, b, "k", ["budget", "steps"], ["prefill"]).collect()}
    assert got == {"budget": "match", "steps": "unchecked", "prefill": "match"}


def test_lineage_gap_leaves_out_unresolved(spark):
    c = spark.createDataFrame([(1, 10, True), (1, 11, True), (2, 10, False), (3, 99, True)], "child int, root int, child_solved boolean")
    p = spark.createDataFrame([(10, True), (11, False)], "root int, solved boolean")
    assert sorted(map(tuple, scoring.lineage_gap(c, p).collect())) == [(1, True, False), (2, False, True)]


def test_mmr_spreads(spark):
    rows = [(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.01]), (1, 3, 0.6, [0.6, 0.8])]
    got = retrieval.mmr(spark.createDataFrame(rows, "query long, card long, relevance double, vec array<double>"), 2, 0.5).collect()
    assert [(r.card, r.place) for r in got] == [(1, 1), (3, 2)]


def test_sources(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": "x", "n": 1}\n\nnot json\n{"id": "y"}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    assert sorted(r.id for r in files.read_jsonl(spark, str(path), schema, tolerant=True).collect()) == ["x", "y"]
    (tmp_path / "b.csv").write_text('id,n\n"two\nlines",3\n')
    assert files.read_rows(spark, str(tmp_path / "b.csv"), schema).first().id == "two\nlines"
    with pytest.raises(ValueError, match="no reader"):
        files.read_rows(spark, "x.txt")
    out = spark.createDataFrame([("b",), ("a",)], "id string")
    files.write_guarded(out, str(tmp_path / "out"), "id", out.where("id = 'a'"))
    with pytest.raises(ValueError, match="lost"):
        files.write_guarded(out.where("id = 'b'"), str(tmp_path / "out2"), "id", out)
    both = files.read_campaigns(spark, {"one": str(path), "two": str(path)}, schema)
    assert sorted({r._campaign for r in both.collect()}) == ["one", "two"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = (("x", True, 1), ("x", True, 2), ("", True, 3), ("", False, 4), ("y", True, 5))
    (src / "a.json").write_text("\n".join(json.dumps({"cell": "c", "text": t, "bad": b, "at": i}) for t, b, i in reversed(rows)))
    stream = online.episode_stream(spark, str(src), T.StructType.fromDDL("cell string, text string, bad boolean, at int"))

    def result(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sorted(r.text for r in result(online.online_dedup(stream), "seen", "append")) == ["", "", "x", "y"]
    assert [tuple(r) for r in result(online.failure_streaks(stream, "cell", "bad", "at"), "runs", "update")] == [("c", 1, True)]
    assert [tuple(r) for r in result(online.latest_outcomes(stream, "cell", "at", "text"), "last", "complete")] == [("c", "y", 5)]
    for _ in range(2):  # a second run has nothing to add, even without the checkpoint of the first
        q = online.resume_into(stream, str(tmp_path / "out"), str(tmp_path / f"check{_}"), "at").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["at"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 5]


def test_layouts_and_sinks(spark, tmp_path):
    schema = T.StructType.fromDDL("id string, n long")
    assert files.read_cards(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    (tmp_path / "cards.jsonl").write_text('{"id": "a", "n": 1}\n[1, 2]\n\n{"id": \nnull\n{"id": "b", "n": 2}\n')
    assert [tuple(r) for r in files.read_cards(spark, str(tmp_path / "cards.jsonl"), schema).collect()] == [("a", 1), ("b", 2)]
    for name in ("raw/a.jsonl", "raw/a.jsonl.bak", "more/burned/x.jsonl", "more/deep/y.jsonl", "more/z.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('{"id": "' + name + '", "n": 1}\n')
    assert [r.id for r in files.cell_episodes(spark, str(tmp_path / "raw"), str(tmp_path / "more"), schema).collect()] == ["raw/a.jsonl"]
    assert files.cell_episodes(spark, str(tmp_path / "no"), str(tmp_path / "nor"), schema).count() == 0
    assert [r.id for r in files.discover(spark, str(tmp_path / "more"), schema, ("z.jsonl",)).collect()] == ["more/deep/y.jsonl"]
    assert [x.rsplit("/", 1)[1] for x in files.data_files(spark, str(tmp_path / "more"), ["*.parquet", "deep/*", "*"])] == ["y.jsonl"]
    with pytest.raises(FileNotFoundError):
        files.data_files(spark, str(tmp_path / "more"), ["*.parquet"])
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], schema)
    files.write_split(df, str(tmp_path / "split"), "id", F.col("n") > 1)
    assert [[r.id for r in spark.read.schema(schema).json(str(tmp_path / "split" / x)).orderBy("id").collect()] for x in ("accepted", "rejected")] == [["b"], ["a", "c"]]
    files.write_groups(df, spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c"), ("h", "z")], "group string, id string"), str(tmp_path / "groups"), "id")
    assert sorted(r.id for r in spark.read.option("header", True).csv(str(tmp_path / "groups")).collect()) == ["a", "b"] and not (tmp_path / "groups" / "group=h").exists()
    flat = files.flattened(spark.createDataFrame([(["x", "y", "z"], {"k": 1}, ("p", [1]))], "l array<string>, m map<string,int>, s struct<a:string,b:array<int>>"), 2).first()
    assert flat.asDict() == {"l": "x;y", "m": '{"k":1}', "s_a": "p", "s_b": "1"}


def test_frozen_cells(spark):
    before = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), ("c", 4, "z")], "cell string, k int, v string")
    after = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "Z"), ("d", 4, "z")], "cell string, k int, v string")
    found = files.differing(files.frozen(before, "cell"), files.frozen(after, "cell"), "cell").collect()
    assert {r.cell: r.state for r in found} == {"b": "changed", "c": "missing", "d": "new"}
    assert files.unchanged(before.where("k < 3"), after, "k", ["cell", "v"]) is after
    for lost in (before, before.where("k = 3")):
        with pytest.raises(ValueError, match="frozen"):
            files.unchanged(lost, after, "k", ["v"]) and files.unchanged(lost, after.where("k < 4"), "k", ["v"])


def test_capitals_are_one_letter_each(spark):
    said = [("straße ä", "STRAẞE Ä"), ("ᾳ ﬁ ŉ ΐx", "ᾼ ﬁ ŉ ΐX"), ("ᾼßß", "ᾼẞẞ"), ("plain é", "PLAIN É"), ("", ""), (None, None)]
    got = spark.createDataFrame(said, "a string, b string").select(tx.capitals(F.col("a")).alias("x"), "b").collect()
    assert [r.x for r in got] == [r.b for r in got]


def test_a_task_sends_k_cards_of_a_query_at_most(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (2_500, 4)).astype(float)
    cards = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vec array<double>").coalesce(1)
    unit = retrieval._unit(vectors)
    assert retrieval._near_block(cards, np.arange(3), unit[:3], 5).groupBy("query").count().where("count > 5").isEmpty()
    sim = np.round(unit[:3] @ unit.T, 9)
    want = {(q, c, r + 1) for q in range(3) for r, c in enumerate([int(c) for c in np.lexsort((np.arange(2_500), -sim[q])) if c != q][:5])}
    assert {(r["query"], r.card, r["rank"]) for r in retrieval.vector_topk(cards.where("id < 3"), cards, 5).collect()} == want
