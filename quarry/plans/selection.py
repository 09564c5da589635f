"""Queries of selection, memory and filters over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import filters
from quarry.operators import memory, selection
from quarry.plans.queries import query
from quarry.plans.views import table


@query("""WITH o AS (SELECT p_partkey, p_size, regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g') AS s FROM part WHERE p_partkey % 3 <> 0), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY s ORDER BY p_size DESC, p_partkey) = 1)
SELECT p_partkey, p_size FROM f ORDER BY p_size DESC, p_partkey LIMIT 40""")
def seed_rows(spark, sf_dir):
    """The first 40 sound rows by generation, each statement once."""
    part = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0")
    surface = F.regexp_replace(F.lower(F.trim("p_name")), r"\s+", " ")
    return selection.first_distinct(part, surface, 40, F.desc("p_size"), F.asc("p_partkey")).select("p_partkey", "p_size")


@query("""WITH s AS (SELECT c_mktsegment, count(*) AS size FROM customer WHERE c_nationkey < 15 GROUP BY 1), e AS (SELECT *, size * 37 / sum(size) OVER () AS exact FROM s), b AS (SELECT *, greatest(1, floor(exact)) AS base FROM e),
q AS (SELECT *, least(size, base + (row_number() OVER (ORDER BY exact - base DESC, c_mktsegment) <= 37 - sum(base) OVER ())::INT) AS quota FROM b),
r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer WHERE c_nationkey < 15) SELECT c_mktsegment, c_custkey, place FROM r JOIN q USING (c_mktsegment) WHERE place <= quota""")
def quota_sample(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey < 15")
    return selection.by_quota(c, "c_mktsegment", 37, F.desc("c_acctbal"), F.asc("c_custkey")).select("c_mktsegment", "c_custkey", "place")


@query("""WITH r AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY -s_acctbal, s_suppkey) - 1 AS p FROM supplier)
SELECT s_suppkey, p // 4 AS round, CASE WHEN (p // 4) % 2 = 0 THEN p % 4 ELSE 3 - p % 4 END AS "group" FROM r""")
def dealt_groups(spark, sf_dir):
    return selection.deal(table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey", 4).select("s_suppkey", "round", "group")


@query("""WITH h AS (SELECT p_brand, count(*) % 5 AS have FROM part WHERE p_size > 40 GROUP BY 1), r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
l AS (SELECT p_brand, p_partkey, coalesce(have, 0) + k - 1 AS level, k FROM r LEFT JOIN h USING (p_brand)) SELECT p_brand, p_partkey, level FROM l ORDER BY level, p_brand, k LIMIT 60""")
def balanced_draw(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    have = part.where("p_size > 40").groupBy("p_brand").agg((F.count("*") % 5).alias("have"))
    return selection.balanced(part.select("p_brand", "p_partkey"), "p_brand", 60, have, F.asc("p_partkey")).select("p_brand", "p_partkey", "level")


@query("""SELECT p_name, max(p_retailprice) AS p_retailprice, contains(p_name, 'red')::INT + contains(p_name, 'small')::INT AS hits FROM part GROUP BY 1""")
def ranked_candidates(spark, sf_dir):
    return selection.best_candidates(table(spark, sf_dir, "part"), "p_name", "p_retailprice", ["red", "small"])


@query("""WITH w AS (SELECT n_name AS rule, n_regionkey::VARCHAR AS category, CASE WHEN n_regionkey = 1 THEN 2 ELSE 0 END + CASE WHEN n_nationkey % 9 = 1 THEN 3 ELSE 0 END - CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 0 END AS score FROM nation),
r AS (SELECT *, CASE WHEN score > 0 THEN row_number() OVER (ORDER BY score DESC, rule) END AS r, count(*) FILTER (score > 0) OVER () AS n, CASE WHEN score <= 0 THEN row_number() OVER (PARTITION BY score > 0, category ORDER BY rule) END AS spare FROM w),
p AS (SELECT *, coalesce(r, n + row_number() OVER (PARTITION BY score > 0 ORDER BY spare NULLS FIRST, rule)) AS place FROM r) SELECT rule, category, score, place FROM p WHERE r <= 3 OR (r IS NULL AND place <= 9)""")
def rule_priority(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("rule"), F.col("n_regionkey").cast("string").alias("category"), "n_regionkey", "n_nationkey")
    w = F.when(F.col("n_regionkey") == 1, 2).otherwise(0) + F.when(F.col("n_nationkey") % 9 == 1, 3).otherwise(0) - F.when(F.col("n_nationkey") % 2 == 0, 4).otherwise(0)
    return selection.ranked_rules(n, w, 3, 9).select("rule", "category", "score", "place")


_LESSONS = {"short": "say more", "symbols": "write words", "listing": "write sentences"}


@query("""WITH f AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 400 THEN 'say more' END, CASE WHEN contains(text, '%') THEN 'write words' END, CASE WHEN contains(text, '|') THEN 'write sentences' END], lambda x: x IS NOT NULL) AS own FROM documents)
SELECT doc_id, array_to_string((own || ['be clear', 'be kind'])[:3], '; ') AS lessons FROM f""")
def lessons_for_slot(spark, sf_dir):
    t = F.col("text")
    flags = F.array_compact(F.array(F.when(F.col("n_chars") < 400, "short"), F.when(t.contains("%"), "symbols"), F.when(t.contains("|"), "listing")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(selection.lessons(flags, ["be clear", "be kind"], _LESSONS, 3), "; ").alias("lessons"))


@query("""WITH w AS (SELECT p_partkey, p_brand, p_type, p_size, p_size < 5 AS weak FROM part), d AS (SELECT *, NOT weak AND row_number() OVER (PARTITION BY weak, p_brand || p_type || p_size % 7 ORDER BY p_size DESC, p_partkey) > 1 AS dup FROM w),
c AS (SELECT *, row_number() OVER (PARTITION BY weak, dup, p_brand ORDER BY p_size DESC, p_partkey) AS k FROM d) SELECT p_partkey, CASE WHEN weak THEN 'weak' WHEN dup THEN 'duplicate_signature' WHEN k > 6 THEN 'family_cap' ELSE 'selected' END AS role FROM c""")
def pool_roles(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("signature", F.concat("p_brand", "p_type", (F.col("p_size") % 7).cast("string")))
    return selection.pool(part, "p_partkey", "p_brand", "signature", F.col("p_size") < 5, 6, F.desc("p_size")).select("p_partkey", "role")


@query("""WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'purchase'),
t AS (SELECT user_id, event_id, count(*) FILTER (event_type <> 'purchase') OVER w AS put, count(*) FILTER (event_type = 'purchase') OVER w AS got FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
q AS (SELECT t.user_id, t.event_id, least(t.got, min(s.put - s.got) + t.got) AS served FROM t JOIN t s ON s.user_id = t.user_id AND s.event_id <= t.event_id GROUP BY t.user_id, t.event_id, t.got),
o AS (SELECT user_id, served AS n, min(event_id) AS o FROM q GROUP BY ALL), r AS (SELECT l.*, o FROM l LEFT JOIN o USING (user_id, n)), b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS back FROM r)
SELECT event_id, event_type, o AS outcome, back, CASE WHEN o IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS prior FROM b WHERE back <= 400""")
def judgement_memory(spark, sf_dir):
    """The last 400 judgements of each kind, resolved by outcomes that came later."""
    ev = table(spark, sf_dir, "events")
    log = ev.where("event_type <> 'purchase'").select("user_id", "event_id", "event_type")
    outcomes = ev.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("outcome"))
    return memory.recent(memory.resolved(log, outcomes, "user_id", "event_id"), "event_type", "event_id", 400).select("event_id", "event_type", "outcome", "back", "prior")


@query("""WITH x AS (SELECT p_partkey, ([NULL, '', 'f' || p_size])[p_partkey % 3 + 1] AS family, ([NULL, 'theorem  T' || p_size || ' :  a', ''])[p_partkey % 3 + 1] AS formal, p_name AS statement, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS m FROM part)
SELECT p_partkey, coalesce(nullif(family, ''), m, 'unknown') AS family, sha256(lower(regexp_replace(coalesce(nullif(formal, ''), statement), '\\s+', ' ', 'g'))) AS digest FROM x""")
def novelty_cards(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda *v: F.element_at(F.array(*v), (k % 3 + 1).cast("int"))
    size = F.col("p_size").cast("string")
    row = {"family": pick(F.lit(None).cast("string"), F.lit(""), F.concat(F.lit("f"), size)), "formal": pick(F.lit(None).cast("string"), F.concat(F.lit("theorem  T"), size, F.lit(" :  a")), F.lit("")), "statement": F.col("p_name")}
    meta = F.when(k % 2 == 0, F.create_map(F.lit("family"), F.col("p_brand"))).otherwise(F.create_map(F.lit("other"), F.col("p_brand")))
    c = memory.card(row, meta)
    return table(spark, sf_dir, "part").select("p_partkey", c["family"].alias("family"), c["digest"].alias("digest"))


_TACTICS = ("simp [h]", "refine ⟨?_, hx⟩", "exact ?_", "sorry", "omega -- axiom x", "native_decide")


@query("""WITH t AS (SELECT event_id, value, event_type, props, (['simp [h]', 'refine ⟨?_, hx⟩', 'exact ?_', 'sorry', 'omega -- axiom x', 'native_decide'])[event_id % 6 + 1] AS t FROM events)
SELECT event_type IN ('click', 'purchase') AS kept_split, value IS NOT NULL AND value >= 5 AND value <= 60 AS in_range, contains(t, 'sorry') OR contains(t, 'axiom ') OR (contains(t, '?_') AND NOT contains(t, 'refine')) AS buggy,
regexp_full_match(event_type || CASE WHEN event_id % 4 = 0 THEN '-x' ELSE '_1' END, '[A-Za-z_][A-Za-z0-9_''.]*') AS named, event_id % 5 = 0 AS system_error, event_id % 3 > 0 OR event_id % 7 = 0 AS redundant, count(*) AS n FROM t GROUP BY ALL""")
def row_filters(spark, sf_dir):
    """How rows fall out under splits, ranges, tactics, names, system errors and evidence of redundancy."""
    k = F.col("event_id")
    tactic = F.element_at(F.array(*map(F.lit, _TACTICS)), (k % 6 + 1).cast("int"))
    tree = F.when(k % 5 == 0, '{"steps": [{"system_error": "lost"}]}').when(k % 5 == 1, '{"system_error": null}').when(k % 5 == 2, '{"system_error": ""}').when(k % 5 == 3, '{"a": {"system_error": false}}').otherwise("{}")
    free = F.when(k % 3 > 0, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>"))
    parents = F.when(k % 7 == 0, F.array(F.lit("p")))
    cols = {
        "kept_split": filters.in_split(F.col("event_type"), ["click", "purchase"]), "in_range": filters.in_range(F.col("value"), 5, 60), "buggy": filters.is_buggy(tactic),
        "named": filters.is_name(F.concat("event_type", F.when(k % 4 == 0, "-x").otherwise("_1"))), "system_error": filters.has_system_error(tree), "redundant": filters.is_redundant(free, parents),
    }
    return table(spark, sf_dir, "events").groupBy(*[c.alias(n) for n, c in cols.items()]).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 7 = 0 THEN 'treatment' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'control' END AS arm, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'e' || o_orderkey END, CASE WHEN o_orderkey % 3 = 1 THEN 'p' || o_custkey END, 'i' || o_custkey) AS id FROM orders),
f AS (SELECT * FROM t WHERE arm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY arm, o_orderkey) = 1) SELECT id, arm, CASE arm WHEN 'control' THEN 0 ELSE 1 END AS generation FROM f""")
def exam_rows(spark, sf_dir):
    """Rows of both arms: treatment is what is certified or accepted by hand, control what has a statement and an answer; ids by the first name that is there, once each."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    arm = F.when((status == "F") | (k % 7 == 0), "treatment").when((status == "O") & (k % 2 == 0), "control")
    tag = lambda p, c, cond: F.when(cond, F.concat(F.lit(p), F.col(c).cast("string")))
    id_ = F.coalesce(tag("e", "o_orderkey", k % 3 == 0), tag("p", "o_custkey", k % 3 == 1), tag("i", "o_custkey", F.lit(True)))
    rows = table(spark, sf_dir, "orders").select(id_.alias("id"), arm.alias("arm"), k).where("arm is not null")
    first = rows.groupBy("id").agg(F.min(F.struct("arm", "o_orderkey")).alias("x"))
    return first.select("id", "x.arm", F.when(F.col("x.arm") == "control", 0).otherwise(1).alias("generation"))
