"""Queries of the parts, shapes and outcomes of statements and proofs, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions import proofs
from quarry.plans.queries import query
from quarry.plans.views import table

#: Orders as formal statements; {k} stands for the customer's number.
_STATEMENTS = (
    "theorem t (a b : ℕ) (h : a < {k}) : a ∣ b := by",
    "theorem t (x : ℝ) (hx : x ≥ {k}) : x ^ 2 > {k} := by",
    "theorem t : p ↔ q{k} := by",
    "theorem t (n : ℕ) (h₁ : n ≤ {k}) (h₂ : n > 12) : ∃ m, m ∈ n := by simp",
    "import M\nopen Nat\n  theorem t : ∀ x : ℕ, x ∈ s{k} := by",
    "lemma t {c : ℕ} : f c = {k}",
    "theorem t (h : p) : p := trivial",
    "no colon here {k}",
)
_GOALS = ("divisibility", "inequality", "iff", "existential", "universal", "equation", "equation", "other")
_PROOFS = (
    "intro x\n  -- induction later\n  simp [h{k}]\n\nlinarith",
    "induction n with\n| zero => simp\n/- cases\n here -/ omega",
    "· constructor\n  · norm_num\n  · omega -- {k}",
    "exact foo_{k}",
)
_TACTICS = ("intro", "simp", "linarith", "induction", "omega", "constructor", "norm_num", "exact")
_MESSAGES = ("Unknown constant f{k}", "error: Type mismatch at {k}", "unsolved goals", "(deterministic) timeout", "declaration uses 'sorry'", "tactic failed {k}", "")


def _made(texts: tuple[str, ...], key: Column, k: Column) -> Column:
    return F.replace(F.element_at(F.array(*map(F.lit, texts)), (key % len(texts) + 1).cast("int")), F.lit("{k}"), k.cast("string"))


def _sql(texts: tuple[str, ...], key: str, k: str) -> str:
    quoted = ", ".join("'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for t in texts)
    return f"replace(([{quoted}])[({key} % {len(texts)} + 1)::INT], '{{k}}', ({k})::VARCHAR)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("s", _made(_STATEMENTS, F.col("o_orderkey"), F.col("o_custkey")))


_S = f"s AS (SELECT o_orderkey, o_custkey, {_sql(_STATEMENTS, 'o_orderkey', 'o_custkey')} AS s FROM orders)"


@query(f"""WITH {_S} SELECT ({list(_GOALS)})[(o_orderkey % 8 + 1)::INT] AS shape, CASE len(regexp_extract_all(s, '\\([A-Za-z_][A-Za-z0-9_₀-₉'']*\\s*:')) WHEN 0 THEN 'closed' WHEN 1 THEN 'light' WHEN 2 THEN 'light' ELSE 'rich' END AS bucket, count(*) AS n FROM s GROUP BY ALL""")
def statement_shapes(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy(proofs.goal_shape(F.col("s")).alias("shape"), proofs.hypothesis_bucket(F.col("s")).alias("bucket")).agg(F.count("*").alias("n"))


_BOUNDS = "list_sort(list_distinct(list_transform(regexp_extract_all(@, '" + proofs.LITERAL_BOUND.replace("'", "''") + "', 1), lambda x: x::BIGINT)))"


@query(f"""WITH {_S}, p AS (SELECT *, {_sql(_STATEMENTS, '(o_orderkey // 8)', 'o_custkey')} AS parent FROM s), b AS (SELECT o_orderkey, {_BOUNDS.replace('@', 's')} AS own, {_BOUNDS.replace('@', 'parent')} AS had FROM p)
SELECT o_orderkey, array_to_string(list_filter(own, lambda x: NOT list_contains(had, x)), ',') AS bounds FROM b""")
def introduced_bounds(spark, sf_dir):
    parent = _made(_STATEMENTS, F.floor(F.col("o_orderkey") / 8), F.col("o_custkey"))
    return _orders(spark, sf_dir).select("o_orderkey", F.array_join(proofs.introduced_bounds(parent, F.col("s")).cast("array<string>"), ",").alias("bounds"))


@query(f"""WITH p AS (SELECT o_orderkey, {_sql(_PROOFS, 'o_orderkey', 'o_custkey')} AS p FROM orders), c AS (SELECT o_orderkey, regexp_replace(regexp_replace(p, '--[^\\n]*', '', 'g'), '(?s)/-.*?-/', '', 'g') AS c FROM p),
l AS (SELECT *, list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM c)
SELECT o_orderkey, len(l)::INT AS n_steps, array_to_string(list_sort(list_distinct(list_filter(list_transform(l, lambda x: split_part(regexp_replace(x, '^[·<;>| ]+', ''), ' ', 1)), lambda x: list_contains({list(_TACTICS)}, x)))), ',') AS tactics,
regexp_matches(c, '\\binduction\\b') AS uses_induction, regexp_matches(c, '\\b(cases|rcases|obtain|constructor)\\b') AS uses_cases, length(c)::INT AS n_chars FROM l""")
def proof_metrics(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select("o_orderkey", proofs.proof_metrics(_made(_PROOFS, F.col("o_orderkey"), F.col("o_custkey")), _TACTICS).alias("m"))
    return m.select("o_orderkey", "m.n_steps", F.array_join(F.array_sort("m.tactics"), ",").alias("tactics"), "m.uses_induction", "m.uses_cases", "m.n_chars")


@query(f"""WITH {_S} SELECT CASE WHEN regexp_matches(s, ':=\\s*by\\b') THEN regexp_extract(s, '(?s)^(.*?:=\\s*by\\b)', 1) WHEN contains(s, ':=') THEN regexp_extract(s, '(?s)^(.*?:=)', 1) || ' by' ELSE s END AS prefix,
CASE o_orderkey % 8 WHEN 4 THEN 'import M' || chr(10) || 'open Nat' || chr(10) ELSE '' END || 'set_option autoImplicit false' AS header, count(*) AS n FROM s GROUP BY ALL""")
def theorem_prefixes(spark, sf_dir):
    s = F.col("s")
    return _orders(spark, sf_dir).groupBy(proofs.theorem_prefix(s).alias("prefix"), proofs.strict_header(proofs.header_of(s)).alias("header")).agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT event_type, lower({_sql(_MESSAGES, 'event_id', 'user_id')}) AS m FROM events)
SELECT event_type, CASE WHEN contains(m, 'unknown identifier') OR contains(m, 'unknown constant') THEN 'unknown_identifier' WHEN contains(m, 'invalid field') OR contains(m, 'type mismatch') THEN 'signature_drift' WHEN contains(m, 'unsolved goals') THEN 'unsolved_goals'
WHEN contains(m, 'timeout') OR contains(m, 'maxheartbeats') OR contains(m, 'deterministic') THEN 'resource_limit' WHEN contains(m, 'sorry') THEN 'contains_sorry' ELSE 'other' END AS kind, count(*) AS n FROM m GROUP BY ALL""")
def error_kinds(spark, sf_dir):
    kind = proofs.error_kind(_made(_MESSAGES, F.col("event_id"), F.col("user_id")))
    return table(spark, sf_dir, "events").groupBy("event_type", kind.alias("kind")).agg(F.count("*").alias("n"))


_FAULTS = ("", "", "model_timeout: 60", "model_exception: reset", "model returned no fenced lean code", "model used forbidden axiom", "pool died")


@query(f"""WITH t AS (SELECT event_type = 'purchase' AS complete, value > 10 AS ok, {_sql(_FAULTS, 'event_id', 'user_id')} AS e, user_id % 3 = 0 AS open FROM events)
SELECT CASE WHEN complete THEN 'valid_no_sorry' WHEN e LIKE 'model_timeout:%' THEN 'model_timeout' WHEN e LIKE 'model_exception:%' THEN 'model_error' WHEN e LIKE 'model returned%' THEN 'extraction_error' WHEN e LIKE 'model used%' THEN 'policy_rejection'
WHEN e <> '' THEN 'verifier_system_error' WHEN ok AND open THEN 'valid_with_sorry' WHEN ok THEN 'valid_but_incomplete' ELSE 'lean_error' END AS outcome, count(*) AS n FROM t GROUP BY 1""")
def turn_outcomes(spark, sf_dir):
    code = F.when(F.col("user_id") % 3 == 0, "simp\nsorry").otherwise("simp -- sorry")
    outcome = proofs.turn_outcome(F.col("event_type") == "purchase", F.col("value") > 10, _made(_FAULTS, F.col("event_id"), F.col("user_id")), code)
    return table(spark, sf_dir, "events").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_type = 'purchase' AS success, event_id % 23 = 0 AS invalid, event_id % 19 = 0 AS failed, event_id % 7 = 0 AS empty, CASE WHEN user_id % 2 = 0 THEN event_id % 4 END AS tries, event_id % 5 * 100 AS tokens, user_id % 3 * 150 AS budget,
event_id % 6 AS batches, event_id % 11 AS actions, event_id % 3 AS steps FROM events)
SELECT CASE WHEN success THEN 'solved' WHEN invalid THEN 'statement_invalid' WHEN failed THEN 'verifier_error' WHEN empty AND coalesce(tries, 0) = 0 AND tokens = 0 THEN 'generator_empty' WHEN budget > 0 AND tokens >= budget THEN 'token_budget'
WHEN tries = 0 THEN 'generator_empty' WHEN tries IS NOT NULL THEN 'attempts_exhausted' WHEN batches = 0 THEN 'sampler_empty' WHEN actions >= 8 THEN 'action_budget' WHEN steps = 0 THEN 'no_accepted_step' ELSE 'search_exhausted' END AS outcome, count(*) AS n FROM e GROUP BY 1""")
def episode_outcomes(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    r = F.struct(
        (F.col("event_type") == "purchase").alias("success"), (i % 23 == 0).alias("statement_invalid"), (i % 19 == 0).alias("verifier_failed"), (i % 7 == 0).alias("generator_empty"),
        F.when(u % 2 == 0, i % 4).alias("n_attempts"), (i % 5 * 100).alias("tokens_used"), (u % 3 * 150).alias("token_budget"), (i % 6).alias("sampled_batches"), (i % 11).alias("actions"), (i % 3).alias("n_steps"),
    )
    return table(spark, sf_dir, "events").select(r.alias("r")).groupBy(proofs.episode_outcome(F.col("r"), 8).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN f AND b THEN 'restatement' WHEN b THEN 'child_stronger' WHEN f THEN 'child_weaker' ELSE 'undetermined' END AS relation, count(*) AS n FROM (SELECT p_size % 2 = 0 AS f, p_partkey % 3 = 0 AS b FROM part) GROUP BY 1")
def lineage_relations(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(proofs.relation(F.col("p_size") % 2 == 0, F.col("p_partkey") % 3 == 0).alias("relation")).agg(F.count("*").alias("n"))
