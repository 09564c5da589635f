"""Queries of evaluation summaries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import stats
from quarry.operators import evaluation
from quarry.plans.queries import query
from quarry.plans.views import EPISODES, episodes, table

_ROWS = f"""WITH {EPISODES}, m AS (SELECT *, user_id % 5 AS model FROM e),
r AS (SELECT benchmark, model, seed, arm, avg(success::INT) AS a, bool_or(success)::INT AS p FROM m WHERE attempt <= 3 GROUP BY ALL)"""
_CELLS = ", ".join(f"count(*) FILTER (arm = {i}) AS n_{i}, round(100 * avg(a) FILTER (arm = {i}), 6) AS accuracy_{i}, round(100 * avg(p) FILTER (arm = {i}), 6) AS pass_{i}" for i in (0, 1))


@query(f"{_ROWS} SELECT benchmark, model, {_CELLS}, round(100 * (avg(a) FILTER (arm = 0) - avg(a) FILTER (arm = 1)), 6) AS drop_accuracy, round(100 * (avg(p) FILTER (arm = 0) - avg(p) FILTER (arm = 1)), 6) AS drop_pass FROM r GROUP BY ALL")
def evaluation_summary(spark, sf_dir):
    return evaluation.evaluation_summary(episodes(spark, sf_dir).withColumn("model", F.col("user_id") % 5), ["benchmark", "model"])


@query()
def bootstrap_drop(spark, sf_dir):
    """The drop of each benchmark with bounds from 200,000 binomial draws of either arm."""
    rows = evaluation.row_scores(episodes(spark, sf_dir), ["benchmark"], 3)
    of = lambda arm: F.col("arm") == arm
    k = rows.groupBy("benchmark").agg(*[x for i in (0, 1) for x in (F.count_if(of(i) & F.col("passed")).alias(f"k{i}"), F.count_if(of(i)).alias(f"n{i}"))])
    return k.withColumn("b", stats.bootstrap_drop("k0", "n0", "k1", "n1")).select("benchmark", "k0", "n0", "k1", "n1", "b.*")


@query()
def bootstrap_accuracy(spark, sf_dir):
    """Mean accuracy of each benchmark's arms and its drop, with bounds from resampled rows; accuracies are in thirds, and only their histograms reach Python."""
    rows = evaluation.row_scores(episodes(spark, sf_dir), ["benchmark"], 3)
    counted = rows.groupBy("benchmark", "arm", F.col("accuracy").alias("v")).agg(F.count("*").alias("n"))
    values, counts = stats.histogram("v")
    arms = counted.groupBy("benchmark").pivot("arm", [0, 1]).agg(values.alias("v"), counts.alias("c"))
    cell = lambda i: (F.col(f"{i}_v"), F.col(f"{i}_c"))
    key = F.xxhash64("benchmark")
    boot = {"control": stats.bootstrap_mean([cell(0)], key, 1_000), "treatment": stats.bootstrap_mean([cell(1)], key, 1_000), "drop": stats.bootstrap_mean([cell(0), cell(1)], key, 20_000)}
    return arms.withColumns(boot).select("benchmark", *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in boot for c in ("mean", "low", "high")])


_RUNS = "r AS (SELECT conv_id, count(*) AS turns, max(length(text)) > 400 AS passed, NOT bool_or(text LIKE '%!%') AS clean, arg_max(role, turn) AS outcome FROM conversations GROUP BY 1)"


def _runs(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), (F.max(F.length(text)) > 400).alias("passed"), (~F.bool_or(F.contains(text, F.lit("!")))).alias("clean"), F.max_by("role", "turn").alias("outcome"))


@query(f"""WITH {_RUNS}, w AS (SELECT unnest(['rows', CASE WHEN passed THEN 'passes' END, CASE WHEN clean THEN 'clean' END, 'turns_' || least(turns, 5), 'outcome_' || outcome]) AS what FROM r)
SELECT what, count(*) AS n FROM w WHERE what IS NOT NULL GROUP BY 1""")
def proof_summary(spark, sf_dir):
    return evaluation.proof_summary(_runs(spark, sf_dir), [], "turns", F.col("passed"), F.col("clean"), "outcome")


@query("""WITH t AS (SELECT DISTINCT lang, source, 40 AS target FROM documents), d AS (SELECT lang, source, count(*) FILTER (quality = 1) AS n_done, count(*) FILTER (quality <> 1) AS n_empty FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT lang, source, target, coalesce(n_done, 0) AS n_done, coalesce(n_empty, 0) AS n_empty, greatest(target - coalesce(n_done, 0), 0) AS remaining FROM t LEFT JOIN d USING (lang, source)""")
def cell_progress(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    done = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("empty", F.col("quality") != 1)
    return evaluation.progress(done, docs.select("lang", "source").distinct().withColumn("target", F.lit(40)), ["lang", "source"])


@query("""SELECT o_orderstatus AS direction, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS n_passed, count(*) AS known_passed, round(count(*) FILTER (o_totalprice > 150000) / count(*), 6) AS rate_passed,
count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0) AS n_seeds_ok, count(*) FILTER (o_orderkey % 3 <> 0) AS known_seeds_ok, round(count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0) / nullif(count(*) FILTER (o_orderkey % 3 <> 0), 0), 6) AS rate_seeds_ok FROM orders GROUP BY 1""")
def direction_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("direction"), (F.col("o_totalprice") > 150000).alias("passed"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 2 == 0).alias("seeds_ok"))
    return evaluation.direction_rates(rows, "direction", ["passed", "seeds_ok"])


@query(f"{_ROWS}, c AS (SELECT benchmark, model, avg(p) AS p FROM r GROUP BY ALL) SELECT benchmark, count(*) AS n_cells, round(100 * avg(p), 6) AS mean_pct FROM c GROUP BY 1")
def mean_over_cells(spark, sf_dir):
    """Of each benchmark, the mean over its cells, each of which counts the same."""
    rows = evaluation.row_scores(episodes(spark, sf_dir).withColumn("model", F.col("user_id") % 5), ["benchmark", "model"], 3)
    cells = rows.groupBy("benchmark", "model").agg(F.avg(F.col("passed").cast("int")).alias("p"))
    return cells.groupBy("benchmark").agg(F.count("*").alias("n_cells"), F.round(100 * F.avg("p"), 6).alias("mean_pct"))


@query(f"""WITH {EPISODES} SELECT pair, string_agg(arm || ':' || attempt || ':' || outcome, ',' ORDER BY arm, attempt, event_id) AS attempts, coalesce(string_agg(DISTINCT arm::VARCHAR, ',' ORDER BY arm::VARCHAR) FILTER (success), '') AS solved_by FROM e GROUP BY 1""")
def attempts_index(spark, sf_dir):
    """Of each seed, the attempts of all arms in order and the arms that solved it."""
    one = F.struct("arm", "attempt", "event_id", "outcome")
    rows = episodes(spark, sf_dir).groupBy("pair").agg(F.sort_array(F.collect_list(one)).alias("a"), F.sort_array(F.collect_set(F.when(F.col("success"), F.col("arm").cast("string")))).alias("s"))
    return rows.select("pair", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["arm"].cast("string"), x["attempt"].cast("string"), x["outcome"])), ",").alias("attempts"), F.array_join("s", ",").alias("solved_by"))


@query("WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS value FROM part UNION ALL SELECT p_brand FROM part) SELECT value, count(*) AS n FROM w WHERE value <> '' GROUP BY 1")
def variant_counts(spark, sf_dir):
    """Histograms over a field of lists and a field of single values."""
    part = table(spark, sf_dir, "part")
    return evaluation.histogram(part.select(F.split("p_name", " ").alias("v")), "v").unionByName(evaluation.histogram(part, "p_brand"))


@query(f"""WITH {EPISODES}, s AS (SELECT pair, arm, count(*) AS actions, bool_or(success) AS solved FROM e GROUP BY ALL)
SELECT arm, count(*) AS n, round(avg(actions), 1) AS mean_actions, round(avg(solved::INT), 3) AS solve_rate FROM s GROUP BY 1""")
def arm_actions(spark, sf_dir):
    s = episodes(spark, sf_dir).groupBy("pair", "arm").agg(F.count("*").alias("actions"), F.max("success").alias("solved"))
    return s.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("actions"), 1).alias("mean_actions"), F.round(F.avg(F.col("solved").cast("int")), 3).alias("solve_rate"))


@query("""SELECT o_orderstatus, count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'formal:' || o_custkey WHEN o_orderkey % 5 = 0 THEN 'statement:' || o_orderpriority ELSE 'problem:' || o_orderkey END) AS n FROM orders GROUP BY 1""")
def unique_surfaces(spark, sf_dir):
    """Distinct surfaces, each known by the first of its formal text, statement and id that is there."""
    key = lambda name, c, cond: F.when(cond, F.concat(F.lit(f"{name}:"), F.col(c).cast("string")))
    k = F.col("o_orderkey")
    surface = F.coalesce(key("formal", "o_custkey", k % 3 == 0), key("statement", "o_orderpriority", k % 5 == 0), key("problem", "o_orderkey", F.lit(True)))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_distinct(surface).alias("n"))


@query("""WITH c AS (SELECT conv_id, list(length(text)::DOUBLE) FILTER (role = 'assistant') AS nodes, count(*) AS turns FROM conversations GROUP BY 1)
SELECT conv_id, round(CASE WHEN len(coalesce(nodes, [])) > 0 THEN list_avg(nodes) ELSE turns END, 6) AS effort, CASE WHEN len(coalesce(nodes, [])) > 0 THEN 'nodes' ELSE 'turns' END AS unit FROM c""")
def effort_proxy(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "assistant", F.length("text").cast("double"))).alias("nodes"), F.count("*").alias("turns"))
    value, unit = evaluation.effort(F.col("nodes"), F.col("turns"))
    return c.select("conv_id", F.round(value, 6).alias("effort"), unit.alias("unit"))
