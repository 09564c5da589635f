"""Queries over the test tables, one to an operator, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.functions import stats, text as tx
from quarry.operators import fixpoint, gates, keep, retrieval, sampling, scoring
from quarry.operators.ranking import places
from quarry.plans.views import EPISODES, episodes, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_WILSON = "100 * (({k} / {n} + 1.96 * 1.96 / (2 * {n})) {s} 1.96 * sqrt(({k} / {n}) * (1 - {k} / {n}) / {n} + 1.96 * 1.96 / (4 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _pass_sql(k: int) -> str:
    n, p = "n_rows::DOUBLE", "n_passed::DOUBLE"
    return f"""WITH {EPISODES}, s AS (SELECT seed, arg_min(benchmark, attempt) AS benchmark, bool_or(success) AS passed FROM e WHERE attempt <= {k} GROUP BY seed),
    r AS (SELECT benchmark, count(*) AS n_rows, count(*) FILTER (passed) AS n_passed FROM s GROUP BY benchmark)
    SELECT *, round(100 * n_passed / n_rows, 6) AS pct, round({_WILSON.format(k=p, n=n, s="-")}, 6) AS low, round({_WILSON.format(k=p, n=n, s="+")}, 6) AS high FROM r"""


@query(_pass_sql(3))
def pass_at_k(spark, sf_dir):
    return scoring.pass_at_k(episodes(spark, sf_dir), 3)


@query(_pass_sql(1))
def pass_at_1(spark, sf_dir):
    return scoring.pass_at_k(episodes(spark, sf_dir), 1)


@query(f"""WITH {EPISODES}, s AS (SELECT seed, arg_min(benchmark, attempt) AS benchmark, bool_or(success AND attempt = 1) AS f, bool_or(success) AS a FROM e GROUP BY seed),
r AS (SELECT benchmark, count(*) AS n_rows, count(*) FILTER (f) AS first_solved, count(*) FILTER (NOT f) AS first_failed, count(*) FILTER (NOT f AND a) AS rescued FROM s GROUP BY 1)
SELECT *, round(100 * rescued / first_failed, 6) AS yield_pct FROM r""")
def revision_yield(spark, sf_dir):
    return scoring.revision_yield(episodes(spark, sf_dir))


def _pairs(spark, sf_dir):
    rows = episodes(spark, sf_dir).groupBy("pair", "arm").agg(F.min_by("pair_benchmark", "attempt").alias("benchmark"), F.max("success").alias("s"))
    return rows.groupBy("pair").agg(F.min("benchmark").alias("benchmark"), F.bool_or(F.when(F.col("arm") == 0, F.col("s"))).alias("s0"), F.bool_or(F.when(F.col("arm") == 1, F.col("s"))).alias("s1")).where("s0 is not null and s1 is not null")


_PAIRS = f"""WITH {EPISODES}, p AS (SELECT pair, min(pair_benchmark) AS benchmark, bool_or(success) FILTER (arm = 0) AS s0, bool_or(success) FILTER (arm = 1) AS s1 FROM e GROUP BY pair),
j AS (SELECT * FROM p WHERE s0 IS NOT NULL AND s1 IS NOT NULL)"""


@query(_PAIRS + "SELECT benchmark, count(*) FILTER (s0 AND s1) AS n_both, count(*) FILTER (s0 AND NOT s1) AS only_0, count(*) FILTER (s1 AND NOT s0) AS only_1, count(*) FILTER (NOT s0 AND NOT s1) AS n_neither FROM j GROUP BY 1")
def arms_paired(spark, sf_dir):
    c = lambda x, name: F.count_if(F.expr(x)).alias(name)
    return _pairs(spark, sf_dir).groupBy("benchmark").agg(c("s0 and s1", "n_both"), c("s0 and not s1", "only_0"), c("s1 and not s0", "only_1"), c("not s0 and not s1", "n_neither"))


@query()
def mcnemar_exact(spark, sf_dir):
    d = arms_paired(spark, sf_dir)
    return d.select("benchmark", "only_0", "only_1", stats.mcnemar_exact("only_0", "only_1").alias("p"))


_NEW = {f"{b}{i}": _WILSON.format(k=f"k{i}::DOUBLE", n=f"n{i}::DOUBLE", s=s) for i in (0, 1) for b, s in (("l", "-"), ("u", "+"))}


@query(_PAIRS.replace("j AS", "x AS") + f""", c AS (SELECT benchmark, count(*) FILTER (s0) AS k0, count(s0) AS n0, count(*) FILTER (s1) AS k1, count(s1) AS n1 FROM x GROUP BY 1),
w AS (SELECT *, 100 * k0 / n0 AS p0, 100 * k1 / n1 AS p1, {', '.join(f'{v} AS {k}' for k, v in _NEW.items())} FROM c)
SELECT benchmark, k0, n0, k1, n1, round(p0 - p1, 6) AS drop_pp, round(p0 - p1 - sqrt((p0 - l0) * (p0 - l0) + (u1 - p1) * (u1 - p1)), 6) AS low, round(p0 - p1 + sqrt((u0 - p0) * (u0 - p0) + (p1 - l1) * (p1 - l1)), 6) AS high FROM w""")
def drop_newcombe(spark, sf_dir):
    c = _pairs(spark, sf_dir).groupBy("benchmark").agg(F.count_if("s0").alias("k0"), F.count("s0").alias("n0"), F.count_if("s1").alias("k1"), F.count("s1").alias("n1"))
    d, low, high = stats.newcombe(F.col("k0"), F.col("n0"), F.col("k1"), F.col("n1"))
    return c.select("benchmark", "k0", "n0", "k1", "n1", F.round(d, 6).alias("drop_pp"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {EPISODES}, d AS (SELECT pair, min(pair_benchmark) AS benchmark, count(*) FILTER (arm = 0) - count(*) FILTER (arm = 1) AS d FROM e GROUP BY pair HAVING count(DISTINCT arm) = 2),
r AS (SELECT benchmark, d, row_number() OVER (PARTITION BY benchmark ORDER BY abs(d), pair) AS r FROM d WHERE d <> 0)
SELECT benchmark, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::BIGINT AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::BIGINT AS w_minus FROM r GROUP BY 1""")
def wilcoxon_ranks(spark, sf_dir):
    """Signed ranks of differences in attempts; ties are broken by place, without mid-ranks."""
    d = episodes(spark, sf_dir).groupBy("pair").agg(F.min("pair_benchmark").alias("benchmark"), (F.count_if(F.col("arm") == 0) - F.count_if(F.col("arm") == 1)).alias("d"), F.count_distinct("arm").alias("arms")).where("arms = 2 and d <> 0")
    r = places(d.withColumn("size_of", F.abs("d")), "benchmark", "size_of", "pair").withColumn("r", F.col("place") + 1)
    return r.groupBy("benchmark").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0)).alias("w_minus"))


@query("""WITH m AS (SELECT o_orderkey AS child, any_value(o_orderpriority) AS grp, any_value(o_orderstatus) = 'F' AS child_solved, bool_and(p_size IS NOT NULL) AS resolved, bool_and(coalesce(p_size <= 45, false)) AS roots_solved
FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey)
SELECT grp, count(*) AS n, count(*) FILTER (roots_solved) AS q, count(*) FILTER (roots_solved AND NOT child_solved) AS gap, count(*) FILTER (NOT roots_solved AND child_solved) AS rescue,
round(100 * count(*) FILTER (roots_solved AND NOT child_solved) / nullif(count(*) FILTER (roots_solved), 0), 6) AS gap_pct FROM m WHERE resolved GROUP BY grp""")
def lpg_rescue(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("child"), F.col("o_orderpriority").alias("grp"), (F.col("o_orderstatus") == "F").alias("child_solved"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("child"), F.col("l_partkey").alias("root")).join(orders, "child")
    rows = scoring.lineage_gap(edges, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("root"), (F.col("p_size") <= 45).alias("solved"))).join(orders.select("child", "grp"), "child")
    q, c = F.col("roots_solved"), F.col("child_solved")
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(q).alias("q"), F.count_if(q & ~c).alias("gap"), F.count_if(~q & c).alias("rescue"), F.round(F.try_divide(100 * F.count_if(q & ~c), F.count_if(q)), 6).alias("gap_pct"))


@query("""WITH RECURSIVE g AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
r AS (SELECT child, parent AS ancestor, 1 AS depth FROM g UNION ALL SELECT r.child, g.parent, depth + 1 FROM r JOIN g ON r.ancestor = g.child)
SELECT ancestor, depth, count(*) AS n FROM r WHERE ancestor[1] = 'r' GROUP BY ALL""")
def lineage_closure(spark, sf_dir):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = lambda n: table(spark, sf_dir, n)
    edges = t("nation").select(tag("n", "n_nationkey").alias("child"), tag("r", "n_regionkey").alias("parent"))
    edges = edges.unionByName(t("customer").select(tag("c", "c_custkey").alias("child"), tag("n", "c_nationkey").alias("parent"))).unionByName(t("orders").select(tag("o", "o_orderkey").alias("child"), tag("c", "o_custkey").alias("parent")))
    up = edges.select(F.col("child").alias("ancestor"), "parent")
    step = lambda now: now.join(up, "ancestor").select("child", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
    out = fixpoint.until_empty(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), step, ["child", "ancestor"])
    return out.where(F.startswith("ancestor", F.lit("r"))).groupBy("ancestor", "depth").agg(F.count("*").alias("n"))


@query("SELECT p_type AS topic, count(DISTINCT l_orderkey) AS n_rows, count(*) AS n_roots FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def multi_root_topic_mix(spark, sf_dir):
    """A row counts once for each distinct topic of its roots; its roots count each."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per = met.groupBy("p_type", "l_orderkey").agg(F.count("*").alias("k"))
    return per.groupBy(F.col("p_type").alias("topic")).agg(F.count("*").alias("n_rows"), F.sum("k").alias("n_roots"))


@query("""WITH c AS (SELECT p_type, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT round(sum(abs(a / (SELECT sum(a) FROM c) - b / (SELECT sum(b) FROM c))) / 2, 9) AS tvd FROM c""")
def tvd_topics(spark, sf_dir):
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return scoring.total_variation(met, F.col("l_returnflag") == "R", "p_type")


@query("""SELECT year(o_orderdate)::INT AS generation, count(*) AS attempted, count(*) FILTER (o_orderstatus = 'F') AS certified, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS partial,
count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS admitted, count(DISTINCT o_custkey) AS surfaces FROM orders GROUP BY 1""")
def funnel_by_generation(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("generation")).agg(
        F.count("*").alias("attempted"), F.count_if(s == "F").alias("certified"), F.count_if(s == "O").alias("open"), F.count_if(s == "P").alias("partial"),
        F.count_if((s == "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("admitted"), F.count_distinct("o_custkey").alias("surfaces"),
    )


@query("""WITH g AS (SELECT o_orderpriority AS grp, year(o_orderdate) AS gen, 100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*) AS acc FROM orders GROUP BY ALL)
SELECT grp, count(*) AS n, round(regr_slope(acc, gen), 6) AS slope, round(arg_min(acc, gen), 6) AS first_acc, round(arg_max(acc, gen), 6) AS last_acc FROM g GROUP BY grp HAVING count(*) >= 2""")
def slope_by_generation(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("gen")).agg((100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("acc"))
    return g.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.regr_slope("acc", "gen"), 6).alias("slope"), F.round(F.min_by("acc", "gen"), 6).alias("first_acc"), F.round(F.max_by("acc", "gen"), 6).alias("last_acc")).where("n >= 2")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def keep_first(spark, sf_dir):
    return keep.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def keep_last(spark, sf_dir):
    return keep.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_type = 'ECONOMY') DESC, p_size DESC, length(p_name) DESC, p_partkey) = 1")
def best_by_rank(spark, sf_dir):
    order = (F.desc(F.col("p_type") == "ECONOMY"), F.desc("p_size"), F.desc(F.length("p_name")), F.asc("p_partkey"))
    return keep.keep_by(table(spark, sf_dir, "part"), ["p_brand"], *order).select("p_brand", "p_partkey", "p_size")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, CASE WHEN o_orderstatus = 'F' THEN -o_orderkey ELSE o_orderkey END) = 1")
def certified_overrides(spark, sf_dir):
    return keep.certified_over_first(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH d AS (SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN '' ELSE sha256(trim(text, ' ')) END AS fp FROM documents)
SELECT doc_id, fp FROM d QUALIFY fp = '' OR row_number() OVER (PARTITION BY fp ORDER BY doc_id) = 1""")
def dedup_fingerprint(spark, sf_dir):
    return keep.unique_fingerprints(table(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fp")), "fp", "doc_id")


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '_' || substr(sha256(p_partkey::VARCHAR), 1, 10) ELSE p_name END AS p_name FROM part")
def duplicate_id_suffix(spark, sf_dir):
    return keep.suffix_duplicates(table(spark, sf_dir, "part"), "p_name", F.sha2(F.col("p_partkey").cast("string"), 256)).select("p_partkey", "p_name")


def _gated(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", tx.fingerprint(F.col("text")).alias("fp"))
    firsts = docs.groupBy("fp").agg(F.min("doc_id").alias("holder"))
    rows = docs.join(labels, "doc_id", "left").join(firsts, "fp")
    why = gates.first_reason(
        ("empty", F.col("fp") == ""), ("duplicate", F.col("holder") < F.col("doc_id")), ("not_judged", F.col("quality").isNull()), ("rejected_by_first", F.col("quality") == 0),
        ("rejected_by_second", F.col("toxic") == 1), ("too_short", F.col("n_chars") < 200),
    )
    return rows.select("doc_id", "source", why.alias("why_not"), why.isNull().alias("admitted"))


_GATED = """WITH d AS (SELECT doc_id, source, n_chars, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN '' ELSE sha256(trim(text, ' ')) END AS fp FROM documents),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY fp) AS holder FROM d LEFT JOIN labels USING (doc_id)),
g AS (SELECT doc_id, source, CASE WHEN fp = '' THEN 'empty' WHEN holder < doc_id THEN 'duplicate' WHEN quality IS NULL THEN 'not_judged' WHEN quality = 0 THEN 'rejected_by_first' WHEN toxic = 1 THEN 'rejected_by_second' WHEN n_chars < 200 THEN 'too_short' END AS why_not FROM f)"""


@query(_GATED + "SELECT doc_id, source, why_not, why_not IS NULL AS admitted FROM g")
def admission_cascade(spark, sf_dir):
    return _gated(spark, sf_dir)


@query(_GATED + "SELECT coalesce(why_not, 'admitted') AS reason, count(*) AS n, count(DISTINCT source) AS n_sources FROM g GROUP BY 1")
def admission_reasons(spark, sf_dir):
    return _gated(spark, sf_dir).groupBy(F.coalesce("why_not", F.lit("admitted")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


@query("""SELECT source, why_not, count(*) AS n, grouping(source)::INT AS g_source, grouping(why_not)::INT AS g_why FROM (""" + _GATED + """SELECT source, coalesce(why_not, 'admitted') AS why_not FROM g) GROUP BY GROUPING SETS ((source), (why_not), ())""")
def grouping_sets_composition(spark, sf_dir):
    rows = _gated(spark, sf_dir).select("source", F.coalesce("why_not", F.lit("admitted")).alias("why_not"))
    return rows.groupingSets([["source"], ["why_not"], []], "source", "why_not").agg(F.count("*").alias("n"), F.grouping("source").cast("int").alias("g_source"), F.grouping("why_not").cast("int").alias("g_why"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN true WHEN p_size % 2 = 0 THEN false END AS st, p_size > 10 AS pr, CASE WHEN p_type <> 'ECONOMY' THEN p_size % 5 <> 0 END AS au, p_size > 20 AS re, p_size > 35 AS rp FROM part)
SELECT level, count(*) AS n FROM (SELECT CASE WHEN coalesce(st, false) AND pr AND coalesce(au, false) AND re AND rp THEN 'reproducible' WHEN coalesce(st, false) AND pr AND coalesce(au, false) AND re THEN 'kernel_replayed'
WHEN coalesce(st, false) AND pr AND coalesce(au, false) THEN 'proof_checked' WHEN coalesce(st, false) THEN 'statement_checked' ELSE 'none' END AS level FROM p) GROUP BY 1""")
def certificate_level(spark, sf_dir):
    s = F.col("p_size")
    level = gates.certificate_level(F.when(s % 3 != 0, True).when(s % 2 == 0, False), s > 10, F.when(F.col("p_type") != "ECONOMY", s % 5 != 0), s > 20, s > 35)
    return table(spark, sf_dir, "part").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count(*) FILTER ((quality = 1) = (toxic = 0)) AS agree, count(*) FILTER (quality = 0 AND toxic = 1) AS both_reject, round(100 * count(*) FILTER ((quality = 1) = (toxic = 0)) / count(*), 6) AS agree_pct FROM labels""")
def judge_consistency(spark, sf_dir):
    same = (F.col("quality") == 1) == (F.col("toxic") == 0)
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("both_reject"), F.round(100 * F.count_if(same) / F.count("*"), 6).alias("agree_pct"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def judge_matrix(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT lang, quality = 0 AS truth, n_chars < 400 OR regexp_matches(text, '[#%&$]{3}') AS flag FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (truth AND flag) AS tp, count(*) FILTER (NOT truth AND flag) AS fp, count(*) FILTER (truth AND NOT flag) AS fn, count(*) FILTER (NOT truth AND NOT flag) AS tn FROM r GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS prec, round(tp / nullif(tp + fn, 0), 6) AS rec, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS acc FROM c""")
def confusion_prf(spark, sf_dir):
    r = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("quality") == 0).alias("t"), ((F.col("n_chars") < 400) | F.col("text").rlike("[#%&$]{3}")).alias("f"))
    t, f = F.col("t"), F.col("f")
    c = r.groupBy("lang").agg(F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & ~f).alias("tn"))
    ratio = lambda a, b: F.round(F.try_divide(F.expr(a), F.expr(b)), 6)
    return c.select("*", ratio("tp", "tp + fp").alias("prec"), ratio("tp", "tp + fn").alias("rec"), ratio("2 * tp", "2 * tp + fp + fn").alias("f1"), ratio("tp + tn", "tp + fp + fn + tn").alias("acc"))


_SETTINGS = """SELECT {k} AS nation, count(*) % 5 AS attempts, CASE WHEN {k} % 4 > 0 THEN max({b}) > 9900 END AS prefill, CASE WHEN {k} % 7 > 0 THEN (count(*) % 2) END AS steps FROM {t} GROUP BY 1"""


@query(f"""WITH a AS ({_SETTINGS.format(k='c_nationkey', b='c_acctbal', t='customer')}), b AS ({_SETTINGS.format(k='s_nationkey', b='s_acctbal', t='supplier')}),
j AS (SELECT a.nation, unnest([{{'field': 'attempts', 'x': a.attempts::VARCHAR, 'y': b.attempts::VARCHAR}}, {{'field': 'steps', 'x': a.steps::VARCHAR, 'y': b.steps::VARCHAR}},
  {{'field': 'prefill', 'x': coalesce(a.prefill, false)::VARCHAR, 'y': coalesce(b.prefill, false)::VARCHAR}}], recursive := true) FROM a JOIN b USING (nation))
SELECT nation, field, CASE WHEN x IS NULL OR y IS NULL THEN 'unchecked' WHEN x = y THEN 'match' ELSE 'mismatch' END AS verdict FROM j""")
def budget_parity(spark, sf_dir):
    def settings(name, k, b):
        nation = F.col(k)
        return table(spark, sf_dir, name).groupBy(nation.alias("nation")).agg((F.count("*") % 5).alias("attempts"), F.when(F.first(k) % 4 > 0, F.max(b) > 9900).alias("prefill"), F.when(F.first(k) % 7 > 0, F.count("*") % 2).alias("steps"))

    return gates.parity(settings("customer", "c_nationkey", "c_acctbal"), settings("supplier", "s_nationkey", "s_acctbal"), "nation", ["attempts", "steps"], ["prefill"])


@query("""WITH a AS (SELECT c_nationkey AS nation, count(*) % 4 AS digest FROM customer WHERE c_nationkey % 6 <> 0 GROUP BY 1), b AS (SELECT s_nationkey AS nation, count(*) % 4 AS digest FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY 1)
SELECT coalesce(a.nation, b.nation) AS nation, CASE WHEN b.digest IS NULL THEN 'second_missing' WHEN a.digest IS NULL THEN 'first_missing' WHEN a.digest = b.digest THEN 'same' ELSE 'differs' END AS kind FROM a FULL JOIN b USING (nation)""")
def platform_agreement(spark, sf_dir):
    one = lambda t, k, m, name: table(spark, sf_dir, t).where(F.col(k) % m != 0).groupBy(F.col(k).alias("nation")).agg((F.count("*") % 4).alias(name))
    both = one("customer", "c_nationkey", 6, "a").join(one("supplier", "s_nationkey", 5, "b"), "nation", "full")
    return both.select("nation", F.when(F.col("b").isNull(), "second_missing").when(F.col("a").isNull(), "first_missing").when(F.col("a") == F.col("b"), "same").otherwise("differs").alias("kind"))


@query("SELECT lang, count(*) AS todo FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def resume_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("todo"))


@query(f"""WITH {EPISODES}, m AS (SELECT *, outcome = 'error' AND json_extract_string(props, '$.k')::INT < 50 AS bad FROM e), s AS (SELECT seed, arg_min(benchmark, attempt) AS benchmark, count(*) AS n, count(*) FILTER (bad) AS b FROM m GROUP BY seed)
SELECT benchmark, sum(n)::BIGINT AS episodes, count(*) AS n_rows, sum(b)::BIGINT AS compromised, count(*) FILTER (b = n) AS rows_without_measure FROM s GROUP BY 1""")
def compromised_rows(spark, sf_dir):
    bad = (F.col("outcome") == "error") & (F.get_json_object("props", "$.k").cast("int") < 50)
    s = episodes(spark, sf_dir).groupBy("seed").agg(F.min_by("benchmark", "attempt").alias("benchmark"), F.count("*").alias("n"), F.count_if(bad).alias("b"))
    return s.groupBy("benchmark").agg(F.sum("n").alias("episodes"), F.count("*").alias("n_rows"), F.sum("b").alias("compromised"), F.count_if(F.col("n") == F.col("b")).alias("rows_without_measure"))


@query("""WITH x AS (SELECT event_id, event_type, value, user_id % 7 = 0 AS playable FROM events) SELECT event_id, value FROM x WHERE NOT (event_type = 'error' OR (value < 1 AND event_type <> 'purchase') OR (event_type = 'signup' AND playable))""")
def unmeasured_drop(spark, sf_dir):
    drop = (F.col("event_type") == "error") | ((F.col("value") < 1) & (F.col("event_type") != "purchase")) | ((F.col("event_type") == "signup") & (F.col("user_id") % 7 == 0))
    return table(spark, sf_dir, "events").where(~drop).select("event_id", "value")


@query("""WITH t AS (SELECT user_id, event_type <> 'purchase' AS c, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS m FROM events)
SELECT user_id, count(*) FILTER (m = 0) AS tail, count(*) AS n FROM t GROUP BY 1""")
def trailing_run(spark, sf_dir):
    return scoring.trailing_run(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "purchase")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT user_id, n, median(value) FILTER (i <= n // 2) AS before, median(value) FILTER (i > n // 2) AS after FROM r WHERE n >= 20 GROUP BY ALL) SELECT user_id, round(before, 6) AS before, round(after, 6) AS after FROM m WHERE after >= 1.5 * before""")
def speed_cliff(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    n = ev.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 20")
    r = ev.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).join(n, "user_id")
    half = F.floor(F.col("n") / 2)
    m = r.groupBy("user_id").agg(F.median(F.when(F.col("i") <= half, F.col("value"))).alias("before"), F.median(F.when(F.col("i") > half, F.col("value"))).alias("after"))
    return m.where("after >= 1.5 * before").select("user_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("""WITH l AS (SELECT event_type, lag(event_type) OVER w AS prev, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT prev, count(*) AS n, round(max(pv), 6) AS most FROM l WHERE event_type = 'error' AND prev IS NOT NULL GROUP BY prev""")
def previous_row_audit(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_type", F.lag("event_type").over(w).alias("prev"), F.lag("value").over(w).alias("pv"))
    return rows.where("event_type = 'error' and prev is not null").groupBy("prev").agg(F.count("*").alias("n"), F.round(F.max("pv"), 6).alias("most"))


@query("""WITH m AS (SELECT user_id, event_id, event_type <> 'purchase' AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, ts FROM events), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM m WHERE c)
SELECT user_id, count(*) AS length, min(event_id) AS first_id, max(event_id) AS last_id FROM g GROUP BY user_id, g HAVING count(*) >= 10""")
def failure_streaks(spark, sf_dir):
    return scoring.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "purchase", 10)


@query("""WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
c AS (SELECT p_brand, max(v) FILTER (i = n // 3) AS lo, max(v) FILTER (i = 2 * n // 3) AS hi FROM r GROUP BY 1)
SELECT p_brand, count(*) FILTER (p_retailprice <= lo) AS easy, count(*) FILTER (p_retailprice > lo AND p_retailprice <= hi) AS medium, count(*) FILTER (p_retailprice > hi) AS hard FROM part JOIN c USING (p_brand) GROUP BY 1""")
def tertile_difficulty(spark, sf_dir):
    """Cuts at sorted[n // 3] and sorted[2 n // 3] of each brand."""
    part = table(spark, sf_dir, "part")
    r = places(part, "p_brand", "p_retailprice", "p_partkey")
    at = lambda k: F.max(F.when(F.col("place") == F.floor(k * F.col("size") / 3), F.col("p_retailprice")))
    v = F.col("p_retailprice")
    return part.join(r.groupBy("p_brand").agg(at(1).alias("lo"), at(2).alias("hi")), "p_brand").groupBy("p_brand").agg(F.count_if(v <= F.col("lo")).alias("easy"), F.count_if((v > F.col("lo")) & (v <= F.col("hi"))).alias("medium"), F.count_if(v > F.col("hi")).alias("hard"))


@query("""WITH r AS (SELECT c_mktsegment AS grp, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY c_mktsegment) // 7) AS size FROM customer)
SELECT grp, (i // size)::BIGINT AS bin, count(*) AS n, round(100 * count(*) FILTER (c_acctbal > 0) / count(*), 6) AS rate FROM r GROUP BY ALL HAVING count(*) >= 3""")
def equal_count_bins(spark, sf_dir):
    rows = sampling.equal_count_bins(table(spark, sf_dir, "customer").withColumn("grp", F.col("c_mktsegment")), "grp", "c_acctbal", "c_custkey", 7)
    return rows.groupBy("grp", "bin").agg(F.count("*").alias("n"), F.round(100 * F.count_if(F.col("c_acctbal") > 0) / F.count("*"), 6).alias("rate"))


@query("""WITH r AS (SELECT l_partkey AS root, count(*) AS tries, count(*) FILTER (l_returnflag = 'R') AS hits FROM lineitem GROUP BY 1) SELECT root, tries, hits, round((hits + 3 * 0.3) / (tries + 3), 6) AS score FROM r""")
def smoothed_yield(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("root")).agg(F.count("*").alias("tries"), F.count_if(F.col("l_returnflag") == "R").alias("hits"))
    return r.withColumn("score", F.round(sampling.smoothed(F.col("hits"), F.col("tries"), 3.0, 0.3), 6))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey % 50 AS s FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS n FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.s < y.s GROUP BY ALL""")
def used_pairs(spark, sf_dir):
    """Pairs of seeds met in one group; groups are the few lines of an order."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 50)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return g.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b").agg(F.count("*").alias("n"))


_ROBIN = """WITH t AS (SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY md5('7:' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand, p_type) AS size FROM part)
SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY r, size DESC, p_type) AS place FROM t QUALIFY place <= 6"""


@query(_ROBIN)
def round_robin_sample(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "part"), "p_brand", "p_type", 6, "p_partkey", "7").select("p_brand", "p_type", "p_partkey", "place")


def _token_sets(spark, sf_dir):
    sets = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("id"), tx.tokens(F.col("text"), 4).alias("tokens"))
    return sets("documents", "doc_id"), sets("benchmark", "item_id")


_OVERLAPS = """WITH t AS (SELECT 'd' AS k, doc_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '[^0-9a-zA-Z_]+'), lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[0-9]+'))) AS w FROM documents
UNION ALL SELECT 'b', item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^0-9a-zA-Z_]+'), lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[0-9]+'))) FROM benchmark),
u AS (SELECT k, id, len(w) AS n, unnest(w) AS w FROM t),
p AS (SELECT q.id AS query, c.id AS card, count(*) AS shared, count(*)::DOUBLE / (q.n + c.n - count(*)) AS score FROM u q JOIN u c ON q.w = c.w AND q.k = 'd' AND c.k = 'b' GROUP BY q.id, c.id, q.n, c.n)"""


@query(_OVERLAPS + "SELECT card, query, shared, round(score, 9) AS score, row_number() OVER (PARTITION BY card ORDER BY score DESC, query) AS rank FROM p QUALIFY rank <= 3")
def token_jaccard_topk(spark, sf_dir):
    return retrieval.token_topk(*_token_sets(spark, sf_dir), 3).select("card", "query", "shared", F.round("score", 9).alias("score"), "rank")


@query(_OVERLAPS + """, m AS (SELECT query, max(score) AS s FROM p GROUP BY 1)
SELECT doc_id, CASE WHEN coalesce(s, 0) >= 0.9 THEN 'near_duplicate' WHEN coalesce(s, 0) >= 0.12 THEN 'structural_overlap' ELSE 'novel' END AS verdict FROM documents LEFT JOIN m ON query = doc_id""")
def novelty_verdict(spark, sf_dir):
    best = retrieval.token_pairs(*_token_sets(spark, sf_dir), 0.12).groupBy("query").agg(F.max("score").alias("s"))
    s = F.coalesce("s", F.lit(0.0))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(best, F.col("query") == F.col("doc_id"), "left").select("doc_id", F.when(s >= 0.9, "near_duplicate").when(s >= 0.12, "structural_overlap").otherwise("novel").alias("verdict"))


@query("""WITH k AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS card, unnest([{'kind': 'text', 'key': sha256(text)}, {'kind': 'surface', 'key': sha256(lower(regexp_replace(text, '[0-9]+', '#', 'g')))}], recursive := true) FROM documents WHERE text <> ''),
c AS (SELECT kind, key, min(doc_id) AS card, count(DISTINCT doc_id) AS n_cards FROM k WHERE card GROUP BY ALL) SELECT k.doc_id AS query, kind, c.card, n_cards FROM k JOIN c USING (kind, key) WHERE NOT k.card""")
def exact_blockers(spark, sf_dir):
    """Keys are of whole texts: as they stand, and in lower case with numbers blanked."""
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.sha2("text", 256).alias("text"), F.sha2(F.lower(F.regexp_replace("text", "[0-9]+", "#")), 256).alias("surface"))
    labels = table(spark, sf_dir, "labels")
    return retrieval.exact_blockers(docs.join(labels, "doc_id", "left_anti"), docs.join(labels, "doc_id", "left_semi"), ["text", "surface"], "doc_id", "doc_id")


_NEAR = """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS card, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS sim
FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)"""


def _near(spark, sf_dir, k):
    """The k nearest of all vectors for every 50th."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.vector_topk(e.where("id % 50 = 0"), e, k)


@query(_NEAR + "SELECT query, card, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query ORDER BY sim DESC, card) AS rank FROM p QUALIFY rank <= 5")
def cosine_topk(spark, sf_dir):
    return _near(spark, sf_dir, 5).select("query", "card", F.round("sim", 6).alias("sim"), "rank")


@query()
def mmr_select(spark, sf_dir):
    return retrieval.mmr(_near(spark, sf_dir, 24).withColumnRenamed("sim", "relevance"), 5, 0.7)


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 5")
def topk_by_group(spark, sf_dir):
    return retrieval.top_k(table(spark, sf_dir, "customer"), "c_nationkey", 5, F.desc("c_acctbal"), F.asc("c_custkey")).select("c_nationkey", "c_custkey", "rank")


@query("SELECT event_type, event_id, CASE WHEN value > 10 THEN 1.0 ELSE 0.5 END AS prior FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 400")
def last_n_by_operator(spark, sf_dir):
    rows = retrieval.top_k(table(spark, sf_dir, "events"), "event_type", 400, F.desc("ts"), F.desc("event_id"))
    return rows.select("event_type", "event_id", F.when(F.col("value") > 10, 1.0).otherwise(0.5).alias("prior"))


_IDS = "'p' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '__x__s' || l_suppkey ELSE '' END || CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '__mut.hard__' || substr(md5(l_orderkey::VARCHAR), 1, 8) END"


@query(f"""WITH i AS (SELECT DISTINCT {_IDS} AS id FROM lineitem) SELECT id, array_to_string(list_filter(string_split(regexp_replace(id, '(__[a-z]+(\\.[a-z]+)*__[0-9a-f]{{8}})+$', ''), '__x__'), lambda x: x <> ''), ',') AS roots,
len(list_filter(string_split(regexp_extract(id, '__([a-z]+(?:\\.[a-z]+)*)__[0-9a-f]{{8}}$', 1), '.'), lambda x: x <> ''))::INT AS depth FROM i""")
def roots_and_chain(spark, sf_dir):
    n, s = F.col("l_linenumber"), lambda c: F.col(c).cast("string")
    made = F.concat(F.lit("p"), s("l_partkey"), F.when(n % 2 == 0, F.concat(F.lit("__x__s"), s("l_suppkey"))).otherwise(""), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("__mut.hard__"), F.substring(F.md5(s("l_orderkey")), 1, 8))))
    ids = table(spark, sf_dir, "lineitem").select(made.alias("id")).distinct()
    return ids.select("id", F.array_join(tx.roots_of(F.col("id")), ",").alias("roots"), F.size(tx.chain_of(F.col("id"))).alias("depth"))


@query("SELECT CASE WHEN starts_with(p_name, 'small r') THEN 'small_r' WHEN starts_with(p_name, 'small') THEN 'small' WHEN starts_with(p_name, 'red') THEN 'red' ELSE 'other' END AS topic, count(*) AS n FROM part GROUP BY 1")
def longest_prefix_class(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(tx.longest_prefix(F.col("p_name"), {"small": "small", "small r": "small_r", "red": "red"}, "other").alias("topic")).agg(F.count("*").alias("n"))


@query("""SELECT shape, bucket, count(*) AS n FROM (SELECT CASE WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '[!?]') THEN 'call' WHEN regexp_matches(text, '[0-9]') THEN 'number' ELSE 'plain' END AS shape,
CASE WHEN k = 0 THEN 'closed' WHEN k <= 2 THEN 'light' ELSE 'rich' END AS bucket FROM (SELECT text, len(regexp_extract_all(text, ',')) AS k FROM conversations)) GROUP BY ALL""")
def shape_case(spark, sf_dir):
    t, k = F.col("text"), F.regexp_count("text", F.lit(","))
    shape = F.when(t.contains("|"), "table").when(t.rlike("[!?]"), "call").when(t.rlike("[0-9]"), "number").otherwise("plain")
    return table(spark, sf_dir, "conversations").groupBy(shape.alias("shape"), F.when(k == 0, "closed").when(k <= 2, "light").otherwise("rich").alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT item_id, sha256(array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^0-9a-zA-Z_]+'), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')))), ' ')) AS digest FROM benchmark""")
def token_set_hash(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.array_join(tx.tokens(F.col("text")), " "), 256).alias("digest"))


_NAMES = "SELECT p_name AS x FROM part UNION SELECT substr(p_name, 1, p_partkey % 9) || substr(p_name, p_partkey % 9 + 2 + p_partkey % 2) FROM part WHERE p_partkey % 4 = 0"


@query(f"WITH n AS ({_NAMES}) SELECT a.x AS a, b.x AS b, levenshtein(a.x, b.x)::INT AS d FROM n a JOIN n b ON a.x < b.x WHERE levenshtein(a.x, b.x) <= 2 AND levenshtein(a.x, b.x) <= 0.15 * greatest(length(a.x), length(b.x))")
def levenshtein_class(spark, sf_dir):
    """Names, and some with one or two letters left out anywhere, that are at most two edits apart."""
    part, k = table(spark, sf_dir, "part"), (F.col("p_partkey") % 9).cast("int")
    slips = part.where("p_partkey % 4 = 0").select(F.concat(F.substring("p_name", F.lit(1), k), F.expr("substring(p_name, cast(p_partkey % 9 + 2 + p_partkey % 2 as int))")).alias("x"))
    names = part.select(F.col("p_name").alias("x")).unionByName(slips).distinct()
    parts = names.select(F.col("x").alias("a"), F.explode(tx.part_keys(F.col("x"))).alias("key"))
    probes = names.select(F.col("x").alias("b"), F.explode(tx.probe_keys(F.col("x"))).alias("key"))
    met = parts.join(probes, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.where(tx.near_name(F.col("a"), F.col("b"))).select("a", "b", F.levenshtein("a", "b").alias("d"))


_FLAGS = """SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN regexp_matches(text, '[#%&$]{3}') THEN 'symbols' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, 'icensed') THEN 'license' END, CASE WHEN contains(text, ' | ') THEN 'listing' END], lambda x: x IS NOT NULL) AS f FROM documents"""


def _flags(spark, sf_dir):
    t = F.col("text")
    tests = {"short": F.col("n_chars") < 200, "symbols": t.rlike("[#%&$]{3}"), "shouting": t.contains("!!"), "license": t.contains("icensed"), "listing": t.contains(" | ")}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array(*[F.when(c, name) for name, c in tests.items()])).alias("f"))


@query(f"WITH x AS ({_FLAGS}), p AS (SELECT * FROM (VALUES ('short', 'surface'), ('symbols', 'surface'), ('shouting', 'surface'), ('license', 'origin'), ('listing', 'form')) t(flag, category)), e AS (SELECT doc_id, unnest(f) AS flag FROM x) SELECT category, flag, count(*) AS n FROM e JOIN p USING (flag) GROUP BY ALL")
def flag_array_policy(spark, sf_dir):
    policy = spark.createDataFrame([("short", "surface"), ("symbols", "surface"), ("shouting", "surface"), ("license", "origin"), ("listing", "form")], "flag string, category string")
    return _flags(spark, sf_dir).select("doc_id", F.explode("f").alias("flag")).join(F.broadcast(policy), "flag").groupBy("category", "flag").agg(F.count("*").alias("n"))  # five rules are broadcast


@query(f"WITH x AS ({_FLAGS}) SELECT doc_id, CASE WHEN list_has_any(f, ['symbols', 'shouting']) THEN 'severe' WHEN len(f) = 1 AND f[1] = 'license' THEN 'weak' WHEN len(f) > 0 THEN 'other' ELSE 'none' END AS cluster FROM x")
def reject_cluster(spark, sf_dir):
    severe = F.arrays_overlap("f", F.array(F.lit("symbols"), F.lit("shouting")))
    only_weak = (F.size("f") > 0) & (F.size(F.array_except("f", F.array(F.lit("license")))) == 0)
    return _flags(spark, sf_dir).select("doc_id", F.when(severe, "severe").when(only_weak, "weak").when(F.size("f") > 0, "other").otherwise("none").alias("cluster"))


@query("SELECT event_type, (json_extract_string(props, '$.k')::INT // 10)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY ALL")
def json_params(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.floor(F.get_json_object("props", "$.k").cast("int") / 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ':' || length(text), ';' ORDER BY turn) AS trace, min(turn) FILTER (role = 'assistant' AND length(text) > 1005) AS first_hit FROM conversations GROUP BY 1")
def nested_trace_regroup(spark, sf_dir):
    item = F.struct("turn", F.concat_ws(":", "role", F.length("text").cast("string")).alias("t"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ";").alias("trace"), F.min(F.when((F.col("role") == "assistant") & (F.length("text") > 1005), F.col("turn"))).alias("first_hit"))


@query("SELECT c_custkey::VARCHAR AS problem_id, c_name AS statement, NULL::VARCHAR AS family, c_mktsegment AS benchmark, greatest(c_acctbal, 0) AS score FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, NULL, 'supplier', greatest(s_acctbal, 0) FROM supplier")
def fixed_schema_projection(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("problem_id"), F.col("c_name").alias("statement"), F.col("c_mktsegment").alias("benchmark"), F.greatest("c_acctbal", F.lit(0.0)).alias("score"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("problem_id"), F.col("s_name").alias("statement"), F.lit("supplier").alias("benchmark"), F.greatest("s_acctbal", F.lit(0.0)).alias("score"))
    return c.unionByName(s).select("problem_id", "statement", F.lit(None).cast("string").alias("family"), "benchmark", "score")


@query("""WITH a AS (SELECT l_orderkey, list(l_linestatus ORDER BY l_linenumber, l_partkey) AS x FROM lineitem WHERE l_quantity < 25 GROUP BY 1), b AS (SELECT l_orderkey, list(l_linestatus ORDER BY l_linenumber, l_partkey) AS y FROM lineitem WHERE l_quantity >= 25 GROUP BY 1)
SELECT l_orderkey, len(list_filter(x, lambda v: NOT list_contains(y, v)))::INT AS dropped, len(list_filter(y, lambda v: NOT list_contains(x, v)))::INT AS added FROM a JOIN b USING (l_orderkey)""")
def multiset_difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    lists = lambda c, name: li.where(c).groupBy("l_orderkey").agg(F.collect_list("l_linestatus").alias(name))
    both = lists("l_quantity < 25", "x").join(lists("l_quantity >= 25", "y"), "l_orderkey")
    return both.select("l_orderkey", F.size(F.filter("x", lambda v: ~F.array_contains("y", v))).alias("dropped"), F.size(F.filter("y", lambda v: ~F.array_contains("x", v))).alias("added"))


@query("""WITH a AS (SELECT year(o_orderdate) AS cell, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS k FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT year(o_orderdate) AS cell, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS k FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY 1)
SELECT cell::INT AS cell, a.n IS NOT DISTINCT FROM b.n AS same_n, a.k IS NOT DISTINCT FROM b.k AS same_k FROM a FULL JOIN b USING (cell)""")
def manifest_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = lambda m, s: o.where(F.col("o_orderkey") % 3 != m).groupBy(F.year("o_orderdate").alias("cell")).agg(F.count("*").alias(f"n{s}"), F.count_if(F.col("o_orderstatus") == "F").alias(f"k{s}"))
    return one(0, "a").join(one(1, "b"), "cell", "full").select("cell", F.col("na").eqNullSafe(F.col("nb")).alias("same_n"), F.col("ka").eqNullSafe(F.col("kb")).alias("same_k"))


@query()
def bootstrap_pass(spark, sf_dir):
    """Percentile bounds of Pass@3 by binomial draws on counts; only counts reach Python."""
    rows = scoring.pass_at_k(episodes(spark, sf_dir), 3)
    return rows.withColumn("b", stats.bootstrap_share("n_passed", "n_rows", 1_000, 42)).select("benchmark", "b.*")
