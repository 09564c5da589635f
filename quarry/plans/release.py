"""Queries of release assembly, identity and resolution over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import capitals
from quarry.operators import exams, record, release
from quarry.plans.queries import query
from quarry.plans.views import table

_RELEASE = """WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN replace(text, 'a', '') ELSE text END AS text FROM documents),
o AS (SELECT *, doc_id % 4 <> 0 AS has_roundtrip, CASE WHEN doc_id % 4 = 0 OR doc_id % 10 = 0 THEN NULL ELSE doc_id % 9 <> 0 END AS roundtrip, doc_id % 23 = 0 AS has_exclusion, CASE WHEN doc_id % 6 = 0 THEN doc_id % 18 = 0 END AS redundant,
(doc_id % 13 = 0)::INT + (doc_id % 3 <> 0)::INT + (doc_id % 4 <> 0)::INT AS checks FROM d),
j AS (SELECT o.*, quality = 1 AS s1, quality = 1 OR doc_id % 11 = 0 AS s2, toxic = 0 AS k FROM o JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0),
g AS (SELECT *, CASE WHEN has_roundtrip AND NOT roundtrip THEN 'roundtrip_false' WHEN has_roundtrip AND roundtrip IS NULL THEN 'roundtrip_unknown' WHEN has_exclusion THEN 'excluded' WHEN redundant THEN 'redundant'
WHEN NOT s1 AND NOT s2 THEN 'not_strong' WHEN s1 <> s2 THEN 'judges_disagree' WHEN NOT k THEN 'not_kept' END AS why FROM j)"""


def _gated(spark, sf_dir):
    k, when = F.col("doc_id"), F.when
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels")
    ids = docs.select("doc_id")
    evidence = {
        "prune": docs.where(k % 5 == 0).select("doc_id", F.replace("text", F.lit("a"), F.lit("")).alias("pruned")), "dead": ids.where(k % 13 == 0), "comparator": ids.where(k % 3 != 0),
        "roundtrip": ids.where(k % 4 != 0).withColumn("roundtrip", when(k % 10 != 0, k % 9 != 0)), "redundancy": ids.where(k % 6 == 0).withColumn("redundant", k % 18 == 0), "exclusion": ids.where(k % 23 == 0),
    }
    rows = release.overlay(docs, "doc_id", evidence).withColumn("text", F.coalesce("pruned", "text"))
    checks = sum(F.col(f"has_{n}").cast("int") for n in ("dead", "comparator", "roundtrip"))
    run1 = labels.select("doc_id", (F.col("quality") == 1).alias("strong"), (F.col("toxic") == 0).alias("keep"))
    run2 = labels.where(k % 7 != 0).select("doc_id", ((F.col("quality") == 1) | (k % 11 == 0)).alias("strong"), (F.col("toxic") == 0).alias("keep"))
    return release.judged(rows.withColumn("checks", checks), "doc_id", run1, run2).withColumn("why", release.gate())


@query(_RELEASE + " SELECT doc_id, coalesce(why, 'admitted') AS verdict FROM g")
def release_gate(spark, sf_dir):
    """Rows with six tables of evidence and two passes of judges, and why each is not admitted."""
    return _gated(spark, sf_dir).select("doc_id", F.coalesce("why", F.lit("admitted")).alias("verdict"))


@query(_RELEASE + """, a AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY checks DESC, doc_id) AS r FROM g WHERE why IS NULL) SELECT doc_id, checks, sha256(text) AS digest FROM a WHERE r = 1 OR text = ''""")
def release_rows(spark, sf_dir):
    rows = release.one_to_a_text(_gated(spark, sf_dir).where("why is null"), "text", F.desc("checks"), F.asc("doc_id"))
    return rows.select("doc_id", "checks", F.sha2("text", 256).alias("digest"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS verdict, sum(f)::BIGINT AS n_flips FROM (SELECT *, coalesce((lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> event_type)::INT, 0) AS f FROM events) GROUP BY 1""")
def verdict_flips(spark, sf_dir):
    return release.last_verdicts(table(spark, sf_dir, "events").withColumn("verdict", F.col("event_type")), "user_id", "event_id")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_partkey // 3 END AS parent FROM part),
r AS (SELECT id, id::VARCHAR AS new FROM p WHERE parent NOT IN (SELECT id FROM p) UNION ALL SELECT p.id, CASE WHEN p.id % 2 = 0 THEN r.new || '__m' || p.id ELSE split_part(r.new, '__', 1) || '__x' || p.id END FROM p JOIN r ON p.parent = r.id WHERE p.id <> p.parent)
SELECT id, new FROM r""")
def id_migration(spark, sf_dir):
    """Mutations extend their parent's chain, crossovers begin a new one at its root."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.cast("long").alias("id"), F.when(k % 11 == 0, -1).otherwise(F.floor(k / 3)).alias("parent"))
    k, id_ = F.col("id"), F.col("id").cast("string")
    rows = rows.withColumns({"suffix": F.when(k % 2 == 0, F.concat(F.lit("__m"), id_)).otherwise(F.concat(F.lit("__x"), id_)), "restarts": k % 2 != 0})
    return release.migrate_ids(rows, "id", "parent", F.col("suffix"), F.col("restarts"))


@query("""WITH m AS (SELECT ps AS old, 'n' || ps AS new FROM (SELECT DISTINCT l_suppkey AS ps FROM lineitem WHERE l_suppkey % 2 = 0)), g AS (SELECT l_orderkey, list(coalesce(m.new, l_suppkey::VARCHAR) ORDER BY l_linenumber, l_suppkey) AS ids FROM lineitem LEFT JOIN m ON old = l_suppkey GROUP BY 1)
SELECT l_orderkey, array_to_string(ids, ',') AS ids FROM g""")
def remapped_ids(spark, sf_dir):
    """Lists of ids rewritten by a mapping that is a table, in their order."""
    lines = table(spark, sf_dir, "lineitem")
    old = F.col("l_suppkey").cast("string")
    mapping = lines.where("l_suppkey % 2 = 0").select(old.alias("old"), F.concat(F.lit("n"), old).alias("new")).distinct()
    ids = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string")).alias("ids"))
    return release.rewritten(ids, "l_orderkey", "ids", mapping).select("l_orderkey", F.array_join("ids", ",").alias("ids"))


@query("""WITH e AS (SELECT l_orderkey, l_suppkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL), n AS (SELECT l_orderkey, CASE WHEN l_suppkey % 3 = 0 THEN 'n' || l_suppkey // 10 ELSE l_suppkey::VARCHAR END AS k, arg_min(q, l_suppkey::VARCHAR) AS q FROM e GROUP BY ALL)
SELECT l_orderkey, string_agg(k || '=' || q, ',' ORDER BY k) AS entries FROM n GROUP BY 1""")
def remapped_keys(spark, sf_dir):
    """Keys of maps rewritten by a mapping that is a table; several old keys may become one."""
    lines = table(spark, sf_dir, "lineitem")
    supplier = F.col("l_suppkey")
    mapping = lines.where("l_suppkey % 3 = 0").select(supplier.cast("string").alias("old"), F.concat(F.lit("n"), F.floor(supplier / 10).cast("string")).alias("new")).distinct()
    maps = lines.groupBy("l_orderkey", supplier.cast("string").alias("k")).agg(F.sum("l_quantity").cast("long").alias("q")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "q"))).alias("entries"))
    entry = lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    return release.rewritten_keys(maps, "l_orderkey", "entries", mapping).select("l_orderkey", F.array_join(F.transform(F.map_entries("entries"), entry), ",").alias("entries"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS id FROM lineitem), a AS (SELECT l_orderkey AS id, min(l_partkey) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS id, min(l_suppkey) AS p FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), c AS (SELECT o_orderkey AS id, o_custkey AS p FROM orders WHERE o_orderkey % 2 = 0)
SELECT * FROM (SELECT k.id, coalesce(a.p, b.p, c.p) AS parent, CASE WHEN a.p IS NOT NULL THEN 0 WHEN b.p IS NOT NULL THEN 1 WHEN c.p IS NOT NULL THEN 2 END AS origin FROM k LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id)) WHERE parent IS NOT NULL""")
def parent_sources(spark, sf_dir):
    """Parents from what is embedded, else from one file, else from another."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    least = lambda cond, c: lines.where(cond).groupBy(F.col("l_orderkey").alias("id")).agg(F.min(c).alias("parent"))
    last = orders.where("o_orderkey % 2 = 0").join(lines.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"))
    return release.resolve_parents([least("l_returnflag = 'R'", "l_partkey"), least("l_linestatus = 'F'", "l_suppkey"), last], "id")


@query("""WITH b AS (SELECT p_partkey AS root, p_brand AS benchmark FROM part WHERE p_partkey % 10 <> 0), e AS (SELECT l_orderkey, benchmark FROM lineitem LEFT JOIN b ON root = l_partkey WHERE l_linenumber <= 2)
SELECT l_orderkey, CASE WHEN bool_or(benchmark IS NULL) THEN 'unknown' WHEN count(DISTINCT benchmark) = 1 THEN min(benchmark) ELSE 'mixed' END AS benchmark FROM e GROUP BY 1""")
def benchmark_of_roots(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("roots"))
    known = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("root"), F.col("p_brand").alias("benchmark"))
    return release.benchmark_of_roots(rows, "l_orderkey", "roots", known)


@query("""WITH n AS (SELECT c_custkey AS id, c_name AS name, 0 AS file FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name), 1 FROM customer WHERE c_custkey % 2 = 0) SELECT id, arg_max(name, file) AS name FROM n GROUP BY 1""")
def later_name_wins(spark, sf_dir):
    """Names of ids from two files; that of the later one counts."""
    c = table(spark, sf_dir, "customer")
    names = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("file")).unionByName(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.lit(1).alias("file")))
    return names.groupBy("id").agg(F.max_by("name", "file").alias("name"))


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), p AS (SELECT h, min(doc_id) AS probe FROM h GROUP BY 1) SELECT doc_id, probe, doc_id = probe AS probed, probe % 3 = 0 AS verdict FROM h JOIN p USING (h)""")
def verdict_by_hash(spark, sf_dir):
    """One probe to a text; its verdict goes to all rows with that text."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    probes = h.groupBy("h").agg(F.min("doc_id").alias("probe")).withColumn("verdict", F.col("probe") % 3 == 0)
    return h.join(probes, "h").select("doc_id", "probe", (F.col("doc_id") == F.col("probe")).alias("probed"), "verdict")


@query("""WITH a AS (SELECT o_orderkey, ['p' || o_custkey, 's' || (o_orderkey % 50), 't' || o_orderstatus] AS keys FROM orders), l AS (SELECT 'p' || c_custkey AS k FROM customer WHERE c_nationkey = 3 UNION SELECT 's7' UNION SELECT 'tP')
SELECT o_orderkey FROM a WHERE list_has_any(keys, (SELECT list(k) FROM l))""")
def ledger_hits(spark, sf_dir):
    """Rows of which any of three keys is in the ledger."""
    o = table(spark, sf_dir, "orders")
    keys = F.array(F.concat(F.lit("p"), F.col("o_custkey").cast("string")), F.concat(F.lit("s"), (F.col("o_orderkey") % 50).cast("string")), F.concat(F.lit("t"), F.col("o_orderstatus")))
    ledger = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("k")).union(spark.createDataFrame([("s7",), ("tP",)], "k string"))
    return o.select("o_orderkey", F.explode(keys).alias("k")).join(ledger, "k", "left_semi").select("o_orderkey").distinct()


@query("""WITH v AS (SELECT l_partkey AS id, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1) SELECT p_brand, count(*) FILTER (ok) AS playable, count(*) FILTER (NOT ok) AS broken, count(*) FILTER (ok IS NULL) AS unknown FROM part LEFT JOIN v ON id = p_partkey GROUP BY 1""")
def playable_partition(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("ok"))
    return table(spark, sf_dir, "part").join(v, "p_partkey", "left").groupBy("p_brand").agg(F.count_if("ok").alias("playable"), F.count_if(~F.col("ok")).alias("broken"), F.count_if(F.col("ok").isNull()).alias("unknown"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey // 4 AS name, length(o_orderpriority) AS a FROM orders), t AS (SELECT c_custkey AS cand, c_custkey // 4 AS name, length(c_mktsegment) AS b, c_acctbal < 0 AS flagged FROM customer WHERE c_custkey // 4 % 8 < 7),
m AS (SELECT id, cand, flagged, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY -abs(a - b) DESC, cand) AS r FROM s JOIN t USING (name))
SELECT s.id, cand, coalesce(n, 0) AS n_candidates, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'unique' ELSE 'by_similarity' END AS how, flagged FROM s LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (id)""")
def seed_resolution(spark, sf_dir):
    """Seeds matched by name; of several candidates the most similar one counts."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    s = o.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_custkey") / 4).alias("name"), F.length("o_orderpriority").alias("a"))
    name = F.floor(F.col("c_custkey") / 4)
    t = c.where(name % 8 < 7).select(F.col("c_custkey").alias("cand"), name.alias("name"), F.length("c_mktsegment").alias("b"), (F.col("c_acctbal") < 0).alias("flagged"))
    best = s.join(t, "name").groupBy("id").agg(F.count("*").alias("n"), F.max(F.struct((-F.abs(F.col("a") - F.col("b"))).alias("sim"), (-F.col("cand")).alias("c"), "flagged")).alias("x"))
    how = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "unique").otherwise("by_similarity")
    return s.join(best, "id", "left").select("id", (-F.col("x.c")).alias("cand"), F.coalesce("n", F.lit(0)).alias("n_candidates"), how.alias("how"), "x.flagged")


@query("""WITH l AS (SELECT doc_id AS k, text, lang, quality = 1 AS s1, quality = 1 OR doc_id % 11 = 0 AS s2, toxic = 0 AS kp FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0),
e AS (SELECT *, k % 4 <> 0 AS rt, CASE WHEN k % 4 <> 0 AND k % 10 <> 0 THEN k % 9 <> 0 END AS eq, k % 6 = 0 AS md, k % 6 = 0 AND k % 18 = 0 AS fr, k % 23 = 0 AS ex, k % 5 = 0 AS pr, k % 13 = 0 AS de, k % 8 = 0 AND k % 3 = 0 AS rw, CASE WHEN lang = 'de' THEN 'mutation_silent' ELSE 'mutation' END AS v FROM l)
SELECT k AS doc_id, sha256(CASE WHEN rw THEN upper(text) ELSE text END) AS statement, CASE WHEN pr THEN 'pruned ' || k ELSE 'formal ' || k END AS formal,
concat_ws('|', 'statement_type_check:' || CASE WHEN k % 2 = 0 THEN 'type-checks' ELSE 'not run' END, 'proof_accepted:' || CASE WHEN k % 3 <> 0 THEN 'accepted, no sorry' ELSE 'not run' END,
'axiom_audit:' || CASE WHEN k % 5 = 1 THEN 'not run' WHEN k % 5 = 2 THEN 'disallowed: sorryAx' ELSE 'closed over propext, Quot.sound' END, 'vacuity:' || CASE k % 3 WHEN 0 THEN 'not run' WHEN 1 THEN 'VACUOUS' ELSE 'hypotheses are satisfiable' END,
'dead_hypotheses:' || CASE WHEN pr THEN 'removed h1, h' || k WHEN de THEN 'every hypothesis is load-bearing' ELSE 'not run' END, 'corpus_dedup:' || CASE WHEN k % 9 = 1 THEN 'not run' WHEN k % 9 = 2 THEN 'duplicate of ' || (k - 1) ELSE 'unique against 500 statements' END,
'redundancy:' || CASE WHEN NOT md THEN 'not run' WHEN fr THEN 'hypotheses Lean could drop: h2, h3' ELSE 'no hypothesis Lean could drop, no parent it could prove alone' END, 'hypothesis_preservation:' || CASE k % 4 WHEN 0 THEN 'not run' WHEN 1 THEN 'changed' ELSE 'every hypothesis the parent had is still there' END,
'comparator:' || CASE WHEN k % 6 = 2 THEN 'statement, axioms and kernel acceptance independently replayed' WHEN k % 3 = 1 THEN 'workspace prepared and ready; kernel replay still pending' ELSE 'not run' END,
'goal_roundtrip:' || CASE WHEN eq THEN 'elaborated goal reads back as the stated problem' WHEN NOT eq THEN 'MISMATCH: a; b' WHEN rt THEN 'check did not complete' ELSE 'not run' END) AS results,
9 AS n_applies,
CASE WHEN rt AND NOT eq THEN 'prose does not describe the elaborated goal' WHEN rt AND eq IS NULL THEN 'goal round-trip never returned a verdict' WHEN ex THEN 'held back by hand: a binder that can be substituted away' WHEN fr THEN 'Lean proved it without a hypothesis it states'
WHEN NOT (s1 AND s2) THEN 'not strong in both passes' WHEN NOT kp THEN 'not kept in both passes' END AS why FROM e""")
def release_records(spark, sf_dir):
    """Records with eight tables laid over them, what each of ten checks says, and why a row is not admitted."""
    k = F.col("doc_id")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ids, when = docs.select("doc_id"), F.when
    names = lambda c, *v: when(c, F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>"))
    evidence = {
        "prune": ids.where(k % 5 == 0).select(k, F.concat(F.lit("pruned "), k.cast("string")), F.lit("by simp"), F.array(F.lit("h1"), F.concat(F.lit("h"), k.cast("string")))), "dead": ids.where(k % 13 == 0).select(k, F.array(F.lit("h9"))),
        "comparator": ids.where(k % 3 == 1).select(k, F.lit(True)), "replays": ids.where(k % 2 == 0).select(k, k % 6 == 2), "roundtrip": ids.where(k % 4 != 0).select(k, when(k % 10 != 0, k % 9 != 0), F.array(F.lit("a"), F.lit("b")), F.lit("as said")),
        "redundancy": ids.where(k % 6 == 0).select(k, F.lit(True), names(k % 18 == 0, "h2", "h3"), names(F.lit(False)), F.lit("")), "rewrites": docs.where(k % 8 == 0).select(k, k % 3 == 0, capitals(F.col("text"))), "exclusions": ids.where(k % 23 == 0).select(k, F.lit("by hand")),
    }
    own = docs.select(
        "doc_id", F.col("text").alias("statement"), F.concat(F.lit("formal "), k.cast("string")).alias("formal"), F.lit("by omega").alias("code"), when(F.col("lang") == "de", "mutation_silent").otherwise("mutation").alias("variant"),
        F.struct((k % 2 == 0).alias("statement"), (k % 3 != 0).alias("proof"), (k % 5 != 1).alias("audited"), (k % 5 != 2).alias("allowed"), when(k % 5 == 2, F.array(F.lit("sorryAx"))).otherwise(F.array(F.lit("propext"), F.lit("Quot.sound"))).alias("axioms")).alias("certificate"),
        when(k % 3 != 0, k % 3 == 1).alias("vacuous"), when(k % 9 != 1, 500).alias("corpus"), when(k % 9 == 2, k - 1).alias("duplicate_of"), when(k % 4 != 0, k % 4 != 1).alias("preserved"),
    )
    run = lambda strong, some: labels.where(some).select("doc_id", strong.alias("strong"), (F.col("toxic") == 0).alias("keep"))
    rows = release.judged(record.assembled(own, "doc_id", evidence), "doc_id", run(F.col("quality") == 1, F.lit(True)), run((F.col("quality") == 1) | (k % 11 == 0), k % 7 != 0))
    done = rows.select("doc_id", F.sha2("statement", 256).alias("statement"), "formal", record.checks().alias("c"), record.admission().alias("a"))
    shown = F.array_join(F.transform(F.array(*[F.lit(n) for n, _ in record.CHECKS]), lambda n: F.concat(n, F.lit(":"), F.element_at(F.col("c"), n)["result"])), "|")
    return done.select("doc_id", "statement", "formal", shown.alias("results"), F.size(F.filter(F.map_values("c"), lambda c: c["applies"])).alias("n_applies"), "a.why")


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderkey % 10 <> 0 AS st, o_orderkey % 5 <> 1 AS pr, o_orderkey % 3 <> 0 AS ad, o_orderkey % 4 <> 0 AS al FROM orders), r AS (SELECT l_orderkey AS id, count(DISTINCT l_linenumber % 2) AS p, count(DISTINCT l_suppkey % 2) AS d FROM lineitem WHERE l_quantity < 40 GROUP BY 1)
SELECT id, CASE WHEN NOT st THEN NULL WHEN NOT pr THEN 'statement_checked' WHEN NOT (CASE WHEN ad THEN al ELSE id % 7 = 0 END) THEN 'proof_accepted' WHEN p >= 2 AND d = 1 THEN 'kernel_replayed' ELSE 'axiom_audited' END AS level FROM a LEFT JOIN r USING (id)""")
def certificate_levels(spark, sf_dir):
    """How far each row's certificate has come: the last step needs one digest on two platforms."""
    k = F.col("o_orderkey")
    audits = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 10 != 0).alias("statement"), (k % 5 != 1).alias("proof"), (k % 3 != 0).alias("audited"), (k % 4 != 0).alias("allowed"))
    replays = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 2).alias("platform"), (F.col("l_suppkey") % 2).alias("digest"), (F.col("l_quantity") < 40).alias("passed"))
    return record.level(audits, replays, "id", F.col("id") % 7 == 0)


@query(r"""WITH r AS (SELECT doc_id, trim(coalesce(split_part(text, chr(10), 1), '')) AS statement, regexp_extract_all(text || ' ' || doc_id % 7 || ' of 12', '-?\d+')[-1] AS answer FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 100 AND n_chars <= 4000 AND text IS NOT NULL)
SELECT * FROM r WHERE statement <> '' AND answer <> '' ORDER BY doc_id LIMIT 250""")
def benchmark_seeds(spark, sf_dir):
    """The first 250 seeds of a benchmark: of two splits and a range of quality, with a statement and an answer."""
    solution = F.concat("text", F.lit(" "), (F.col("doc_id") % 7).cast("string"), F.lit(" of 12"))
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return exams.benchmark_seeds(docs, "doc_id", F.substring_index("text", "\n", 1), solution, "last_number", ("lang", ["en", "de"]), ("n_chars", 100, 4000), 250)


@query(r"""WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS b, o_custkey AS c FROM orders WHERE o_orderstatus <> 'P') SELECT id, 'exam_' || lower(left(b, 1)) AS benchmark, 'order ' || id AS statement, 'theorem t' || id || ' (n : Nat) : n = ' || c AS formal,
CASE WHEN c % 3 = 0 THEN 'import Mathlib' ELSE 'import A' || c % 3 || chr(10) || 'open Nat' END AS header, (SELECT count(*) FROM r s WHERE s.b = '2-HIGH') AS n_skipped FROM r WHERE b <> '2-HIGH'""")
def exam_rows(spark, sf_dir):
    """Admitted rows with the labels of their benchmarks; how many had none is told beside them."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    formal = F.concat(F.lit("theorem t"), k, F.lit(" (n : Nat) : n = "), c.cast("string"), F.when(c % 2 == 0, " := by\n  omega").otherwise(" :="))
    head = F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("import A"), (c % 3).cast("string"), F.lit("\nopen Nat\n\n")))
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("b"), F.concat(F.lit("order "), k).alias("statement"), formal.alias("formal"), F.concat(head, formal, F.lit("\n  simp")).alias("code"))
    labels = table(spark, sf_dir, "orders").where("o_orderpriority <> '2-HIGH'").select(F.col("o_orderpriority").alias("benchmark")).distinct().withColumn("label", F.concat(F.lit("exam_"), F.lower(F.substring("benchmark", 1, 1))))
    ready, skipped = exams.exam_rows(rows, "id", "b", labels)
    return ready.withColumn("n_skipped", F.lit(skipped.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
