"""Queries of detectors, decisions and number families over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import detectors, families, policy
from quarry.plans.queries import query
from quarry.plans.views import table


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


#: Orders as candidates: two picks among the flags and a few others, a status and a kind.
_PICKS = (*policy.FLAGS, "pipeline_composite", "repeated_signature", "proof_failed", "unsupported")
_CANDIDATES = f"""c AS (SELECT o_orderkey, list_distinct(list_filter([({_list(_PICKS)})[(o_custkey % 71 + 1)::INT], ({_list(_PICKS)})[(o_orderkey % 97 + 1)::INT]], lambda x: x IS NOT NULL)) AS flags,
CASE o_orderstatus WHEN 'F' THEN 'certified' WHEN 'O' THEN 'survivor' ELSE 'proof_failed' END AS status,
CASE o_orderkey % 3 WHEN 0 THEN 'mutation' WHEN 1 THEN 'crossover' ELSE 'survivor' END AS kind,
CASE WHEN o_orderkey % 11 = 0 THEN 'lean_syntax_error' ELSE '' END AS failure, o_orderkey % 5 <> 0 AS changed, o_orderkey % 4 AS seen FROM orders)"""


def _candidates(spark, sf_dir):
    picks = F.array(*map(F.lit, _PICKS))
    pick = lambda key, m: F.get(picks, (F.col(key) % m).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_distinct(F.array_compact(F.array(pick("o_custkey", 71), pick("o_orderkey", 97)))).alias("flags"),
        F.when(F.col("o_orderstatus") == "F", "certified").when(F.col("o_orderstatus") == "O", "survivor").otherwise("proof_failed").alias("status"),
        F.element_at(F.array(F.lit("mutation"), F.lit("crossover"), F.lit("survivor")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("kind"),
        F.when(F.col("o_orderkey") % 11 == 0, "lean_syntax_error").otherwise("").alias("failure"), F.lit("").alias("summary"), F.lit(True).alias("theorem"),
        (F.col("o_orderkey") % 5 != 0).alias("surface_changed"), F.lit(True).alias("has_surface"), (F.col("o_orderkey") % 4).alias("parents_seen"),
    )


_DECIDED = f"""{_CANDIDATES}, s AS (SELECT *, list_sort(list_distinct(flags || CASE WHEN failure <> '' THEN [failure] ELSE [] END || CASE WHEN status = 'proof_failed' THEN [status] ELSE [] END)) AS signals,
list_sort(list_distinct(list_filter(flags, lambda x: NOT list_contains({_list(policy.NOT_WEAK)}, x)) || CASE WHEN status <> 'certified' THEN ['not_certified'] ELSE [] END || CASE WHEN kind = 'survivor' THEN ['not_generated'] ELSE [] END
  || CASE WHEN kind <> 'survivor' AND NOT changed THEN ['formal_surface_not_changed'] ELSE [] END || CASE WHEN kind = 'crossover' AND seen < 2 THEN ['crossover_parent_usage_not_observable'] ELSE [] END)) AS proxy FROM c),
d AS (SELECT *, CASE WHEN status = 'proof_failed' OR list_has_any(flags, {_list(policy.DECREASE)}) OR NOT changed THEN 'decrease' WHEN len(proxy) = 0 OR status = 'certified' THEN 'increase' ELSE 'decrease' END AS direction FROM s)"""


@query(f"""WITH {_CANDIDATES.replace("c AS", "x AS", 1)}, e AS (SELECT o_orderkey, unnest(flags) AS flag FROM x), r AS (SELECT unnest({_list(policy.FLAGS)}) AS flag, unnest({_list(c for _, c in policy.RULES)}) AS category)
SELECT r.flag, r.category, count(o_orderkey) AS n FROM r LEFT JOIN e USING (flag) GROUP BY ALL""")
def rule_registry(spark, sf_dir):
    """How often each rule of the registry is raised, with rules that never are."""
    raised = _candidates(spark, sf_dir).select(F.explode("flags").alias("flag")).groupBy("flag").count()
    return policy.rules(spark).join(raised, "flag", "left").select("flag", "category", F.coalesce("count", F.lit(0)).alias("n"))


@query(f"""WITH {_DECIDED} SELECT o_orderkey, CASE {" ".join(f"WHEN list_has_any(signals, {_list(n)}) THEN '{a}:{b}'" for a, b, n in policy.KINDS)} ELSE 'none:none' END AS kind_of_error, array_to_string(signals, ',') AS signals FROM d""")
def misformalisation(spark, sf_dir):
    d = policy.decide(_candidates(spark, sf_dir))
    return d.select("o_orderkey", F.concat_ws(":", "taxonomy.level", "taxonomy.category").alias("kind_of_error"), F.array_join("taxonomy.signals", ",").alias("signals"))


@query(f"WITH {_DECIDED} SELECT o_orderkey, len(proxy) = 0 AS passes, array_to_string(proxy, ',') AS proxy FROM d")
def accepted_proxy(spark, sf_dir):
    return policy.decide(_candidates(spark, sf_dir)).select("o_orderkey", (F.size("proxy") == 0).alias("passes"), F.array_join("proxy", ",").alias("proxy"))


@query(f"""WITH {_DECIDED}, k AS (SELECT direction, CASE WHEN status <> 'certified' OR kind = 'survivor' THEN 'reject:not_a_generated_certified_candidate' WHEN list_has_any(flags, {_list(policy.REJECT)}) THEN 'reject:hard_reject_flags'
WHEN list_has_any(flags, {_list(policy.SCAFFOLD)}) THEN 'scaffold:certified_scaffold_not_paper_grade' WHEN len(proxy) = 0 AND direction <> 'decrease' THEN 'paper:accepted_proxy_pass'
WHEN direction = 'increase' THEN 'scaffold:certified_entropy_increase_but_not_paper_grade' ELSE 'reject:not_entropy_increasing_or_proxy_failed' END AS decision FROM d)
SELECT direction, decision, count(*) AS n FROM k GROUP BY ALL""")
def curation_decision(spark, sf_dir):
    d = policy.decide(_candidates(spark, sf_dir))
    return d.groupBy("direction", F.concat_ws(":", "curation.class", "curation.reason").alias("decision")).agg(F.count("*").alias("n"))


@query(f"""WITH {_CANDIDATES}, w AS (SELECT *, len(list_filter(flags, lambda x: NOT list_contains({_list(policy.NOT_WEAK)}, x))) AS n, CASE WHEN o_orderkey % 6 = 0 THEN 'pass' WHEN o_orderkey % 6 = 1 THEN 'fail' END AS judge, CASE WHEN kind = 'crossover' THEN o_orderkey % 4 <> 0 END AS coupled FROM c)
SELECT CASE WHEN status <> 'certified' THEN 'fail' WHEN NOT coalesce(coupled, true) THEN 'weak' ELSE coalesce(judge, CASE WHEN n > 0 THEN 'weak' ELSE 'pass' END) END AS verdict, greatest(0, round((o_orderkey % 5) / 4 - 0.15 * n, 2))::DOUBLE AS score, count(*) AS n FROM w GROUP BY ALL""")
def slot_verdicts(spark, sf_dir):
    """Verdicts of flags, judges and measured couplings, and scores of coverage."""
    k = F.col("o_orderkey")
    judge, coupled = F.when(k % 6 == 0, "pass").when(k % 6 == 1, "fail"), F.when(F.col("kind") == "crossover", k % 4 != 0)
    rows = _candidates(spark, sf_dir).select(policy.slot_verdict(F.col("flags"), F.col("status"), judge, coupled).alias("verdict"), policy.slot_score(k % 5 / 4, F.col("flags")).alias("score"))
    return rows.groupBy("verdict", "score").agg(F.count("*").alias("n"))


#: Parts as exercises of a family.
_EXERCISES = f"""x AS (SELECT p_partkey, ({_list(families.FAMILIES)})[(p_partkey % 8 + 1)::INT] AS family, p_partkey * 12 AS a, p_size::BIGINT * 6 AS b, p_size::BIGINT + 1 AS m, p_partkey AS n, p_partkey AS base, p_size::BIGINT AS e, p_size::BIGINT % 4 + 1 AS v, p_partkey % 9 AS t, p_size::BIGINT % 7 AS step FROM part),
y AS (SELECT *, CASE WHEN family LIKE 'gcd%' THEN gcd(a, b) ELSE n END AS k FROM x), z AS (SELECT *, list_filter(range(1, k + 1), lambda d: k % d = 0) AS ds FROM y),
w AS (SELECT *, list_sum(ds)::BIGINT AS sigma, len(ds) AS tau, len(list_filter(ds, lambda d: d > 1 AND len(list_filter(ds, lambda q: d % q = 0)) = 2)) AS pf FROM z)"""


def _exercises(spark, sf_dir):
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    p = {"a": key * 12, "b": size * 6, "m": size + 1, "n": key, "base": key, "exp": size, "vars": size % 4 + 1, "total": key % 9, "terms": key % 9, "first": key, "diff": size % 7}
    family = F.element_at(F.array(*map(F.lit, families.FAMILIES)), (key % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", family.alias("family"), F.struct(*[c.cast("long").alias(n) for n, c in p.items()]).alias("p"))


@query(f"""WITH {_EXERCISES} SELECT p_partkey, family, (CASE family WHEN 'gcd' THEN k WHEN 'gcd_divisor_sum' THEN sigma WHEN 'units_digit' THEN list_reduce([1::BIGINT] || list_transform(range(0, e), lambda i: base), lambda q, r: (q * r) % 10)
WHEN 'divisor_sum' THEN sigma WHEN 'divisor_sum_mod' THEN a % sigma WHEN 'stars_and_bars' THEN factorial((t + v - 1)::INT) / factorial((v - 1)::INT) / factorial(t::INT)
WHEN 'arithmetic_series' THEN t * n + step * t * (t - 1) // 2 ELSE a % m END)::BIGINT AS answer,
(CASE WHEN family LIKE 'gcd%' THEN greatest(a, b) + 50 * pf WHEN family = 'units_digit' THEN e WHEN family = 'divisor_sum' THEN n + 100 * pf WHEN family = 'divisor_sum_mod' THEN n + a // 1000
WHEN family = 'stars_and_bars' THEN 100 * v + t WHEN family = 'arithmetic_series' THEN t * greatest(1, step) ELSE 100 * m + length(a::VARCHAR) END)::BIGINT AS difficulty FROM w""")
def family_answers(spark, sf_dir):
    x = _exercises(spark, sf_dir)
    return x.select("p_partkey", "family", families.expected_answer(F.col("family"), F.col("p")).alias("answer"), families.difficulty(F.col("family"), F.col("p")).alias("difficulty"))


@query(f"""WITH {_EXERCISES}, s AS (SELECT family || ':direct' || CASE WHEN family LIKE 'gcd%' THEN ':gpf' || pf WHEN family LIKE 'divisor%' THEN ':pf' || pf || ':tau' || tau
WHEN family = 'units_digit' THEN ':cycle' || len(list_distinct([base % 10, base * base % 10, base * base % 10 * base % 10, base * base % 10 * base % 10 * base % 10])) WHEN family = 'modular_congruence' THEN ':m_digits' || length(m::VARCHAR) ELSE '' END AS signature FROM w)
SELECT signature, count(*) AS n FROM s GROUP BY 1""")
def reasoning_signatures(spark, sf_dir):
    return _exercises(spark, sf_dir).groupBy(families.signature(F.col("family"), F.lit("direct"), F.col("p")).alias("signature")).agg(F.count("*").alias("n"))


@query(r"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'so = ' || l_partkey || ', hence is ' || l_suppkey WHEN 1 THEN 'it is boxed{' || l_partkey || '} of 7' WHEN 2 THEN 'gives ' || l_suppkey || ' and ' || l_partkey ELSE 'none' END AS t FROM lineitem)
SELECT claim, count(*) AS n FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN regexp_extract(t, 'hence is (\d+)', 1) WHEN 3 THEN NULL ELSE l_partkey::VARCHAR END::BIGINT AS claim FROM s) GROUP BY 1""")
def claimed_answers(spark, sf_dir):
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    k = F.col("l_linenumber") % 4
    said = F.when(k == 0, F.concat(F.lit("so = "), part, F.lit(", hence is "), supp)).when(k == 1, F.concat(F.lit("it is boxed{"), part, F.lit("} of 7"))).when(k == 2, F.concat(F.lit("gives "), supp, F.lit(" and "), part)).otherwise("none")
    return table(spark, sf_dir, "lineitem").groupBy(families.claimed_answer(said).alias("claim")).agg(F.count("*").alias("n"))


#: Orders as formal statements with a parent: formal, lean, parent, statement, plan; {k} is a number of the row.
_SHAPES = (
    ("theorem t{k} (x : ℕ) : x + {k} > 3 := by omega", "by norm_num", "theorem p (x : ℕ) : x + 9 > 3 := by omega", "", ""),
    ("theorem t{k} [Field R] (x : R) : x * {k} = x := by simp", "simp", "theorem p [Ring R] (x : R) : x * {k} = x", "", ""),
    ("theorem t{k} : a < {k} ∧ b < long_bound", "omega", "theorem p : b < long_bound", "", "side by side, carried along"),
    ("theorem t{k} : Nat.divisors {k} = s", "native_decide", "theorem p : s = s", "", "inspired by its parent"),
    ("theorem t{k} (f : Fin 1 → ℕ) : f 0 = {k}", "exact Subsingleton.elim _ _", "theorem p : q", "", ""),
    ("theorem t{k} : -( -{k}) = y", "rw [neg_neg]", "theorem p : q", "", ""),
    ("theorem t{k} : IsUnit (a * b{k})", "exact ha.mul hb", "theorem p : IsUnit a", "", ""),
    ("lemma  t{k} :  same_goal {k}", "assumption", "lemma other : same_goal {k}", "", ""),
    ("theorem t{k} (h : n = 24) : 8 ∣ n", "rw [h]; exhibit 8*k", "theorem p : 24 ∣ n", "24 ∣ n, so 8 divides n", ""),
    ("theorem t{k} : a {k} = 5", "simp", "theorem p : a 0 = 1", "The arithmetic progression has a term", "a hidden index"),
    ("theorem t{k} : a + 20 * d ≤ {k}", "linarith [ap_bound]", "theorem p : ap_bound a + 3 * d", "an arithmetic sequence, with slack", ""),
    ("theorem t{k} : n / 19 = 3", "omega", "theorem p : n * 7 % 398 = 1", "As n * 7 % 398 = 1, n = 57", ""),
    ("theorem t{k} : S.card = 4", "native_decide", "theorem p : q", "The residues mod 8 have cardinality {k}", ""),
    ("theorem t{k} (h : ∀ p, p.Prime → p < {k}) : q.Prime", "exact h q", "theorem p : all_primes", "", ""),
    ("theorem t{k} : x + {k} = 9", "linarith", "theorem p : 3 * x + 2 = 11", "a nearby equation", ""),
    ("theorem t{k} : orderOf u = orderOf v", "simp", "theorem p : q", "A unit and its inverse have one order", ""),
    ("theorem t{k} : ∃ z, z ∣ w", "refine ⟨z, hz⟩", "theorem p : q", "A Gaussian integer by its witness", ""),
    ("theorem t{k} : n < 398", "omega", "theorem p : q", "An arithmetic progression as a bridge to n % 19, 132 + n / 19", ""),
    ("theorem t{k} : p.Prime", "norm_num", "theorem p : sum_of_divisors", "A helper on the sum of divisors of 500", ""),
)


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _shape_sql(i: int) -> str:
    return f"CASE o_orderkey % {len(_SHAPES)} " + " ".join(f"WHEN {n} THEN replace({_sql_text(s[i])}, '{{k}}', o_custkey::VARCHAR)" for n, s in enumerate(_SHAPES)) + " END"


def _flags_sql() -> str:
    """Flags of statements with one parent, by SQL's own functions over the strings."""
    bare = lambda x: rf"lower(trim(regexp_replace(regexp_replace(split_part({x}, ':= by', 1), '\b(theorem|lemma)\s+[A-Za-z0-9_''.]+', '\1 _', 'g'), '\s+', ' ', 'g')))"
    joined = lambda fields: "lower(concat_ws(' ', " + ", ".join(fields) + "))"
    parts = ", ".join(f"{joined(fields)} AS x_{name}" for name, fields in detectors.PARTS.items())
    has = lambda part, x: f"regexp_matches(x_{part}, {_sql_text(x)})"
    words = lambda x: f"regexp_extract_all({x}, '[a-z_][a-z0-9_'']{{2,}}')"
    met = lambda x: f"list_has_any({words('p_end')}, {words(x)})"
    mutation, crossover = (f"(kind = '{k}' AND status = 'certified' AND own <> '')" for k in ("mutation", "crossover"))
    both, held = "regexp_matches(own_end, '∧| and ')", "(length(p_end) >= 8 AND contains(own_end, p_end))"
    blank = lambda x: rf"regexp_replace({x}, '\b\d+\b', '#', 'g')"
    narrowed = " OR ".join(f"(contains(own, '{a}') AND contains(par, '{b}'))" for a, b in detectors.NARROWED)
    found = [
        ("same_formal_statement_as_parent", "own <> '' AND own = par"), ("parameter_shift_only_theorem", f"{mutation} AND {blank('own')} = {blank('par')} AND {has('proof', detectors.MECHANICAL)}"),
        ("auxiliary_conjunct_only_theorem", f"{mutation} AND {both} AND {held}"), ("typeclass_narrowing_only", f"{mutation} AND own_end <> '' AND own_end = p_end AND ({narrowed})"),
        ("side_by_side_conjunction", f"{crossover} AND {both} AND {has('text', detectors.SIDE_BY_SIDE)}"), ("parent_checkpoint_not_consumed", f"{crossover} AND x_lean <> '' AND NOT {met('x_lean')}"),
        ("unused_checkpoint", f"{crossover} AND {has('proof', detectors.PASSED_THROUGH)} AND {met('x_lean')} AND NOT {met('x_goal')}"), ("same_lineage_crossover", "kind = 'crossover' AND a_root = b_root"),
        ("lineage_complexity_without_new_role", f"status = 'certified' AND own <> '' AND depth >= CASE kind WHEN 'mutation' THEN 5 WHEN 'crossover' THEN 6 END AND NOT {has('text', detectors._ROLE)}"),
    ]
    for r in detectors.RULES:
        terms = [has(*n) for n in r.needs] + [f"NOT {has(*n)}" for n in r.lacks] + ([f"kind = '{r.kind}'"] if r.kind else []) + (["status = 'certified' AND kind <> 'survivor'"] if r.certified else [])
        found.append((r.flag, " AND ".join(terms)))
    every = ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in found)
    return rf"""WITH a AS (SELECT o_orderkey, {", ".join(f"{_shape_sql(i)} AS {n}" for i, n in enumerate(("formal", "lean", "parent", "statement", "plan")))}, '' AS evidence, o_custkey % 3 AS a_root, o_custkey % 4 AS b_root, o_custkey % 7 + 1 AS depth,
CASE o_orderkey % 3 WHEN 0 THEN 'mutation' WHEN 1 THEN 'crossover' ELSE 'survivor' END AS kind, CASE WHEN o_orderstatus = 'F' THEN 'certified' ELSE 'failed' END AS status FROM orders),
b AS (SELECT *, {parts}, lower(CASE WHEN formal <> '' THEN formal ELSE lean END) AS x_stated, {bare('formal')} AS own, {bare('parent')} AS par, lower(parent) AS x_parents FROM a),
c AS (SELECT *, regexp_replace(x_text, '\s+', '', 'g') AS x_tight, trim(regexp_extract(own, '[^:]*$')) AS own_end, trim(regexp_extract(par, '[^:]*$')) AS p_end FROM b),
d AS (SELECT *, trim(list_extract(string_split(regexp_extract(own_end, '[^→]*$'), '->'), -1)) AS x_goal FROM c)
SELECT array_to_string(list_sort(list_distinct(list_filter([{every}], lambda x: x IS NOT NULL))), ',') AS flags, count(*) AS n FROM d GROUP BY 1"""


@query(_flags_sql())
def theorem_flags(spark, sf_dir):
    shape = lambda i: F.replace(F.element_at(F.array(*[F.lit(s[i]) for s in _SHAPES]), (F.col("o_orderkey") % len(_SHAPES) + 1).cast("int")), F.lit("{k}"), F.col("o_custkey").cast("string"))
    root = lambda m: F.concat(F.lit("r"), (F.col("o_custkey") % m).cast("string"), F.lit("__theorem_gen1"))
    rows = table(spark, sf_dir, "orders").select(
        shape(3).alias("statement"), shape(0).alias("formal"), shape(1).alias("lean"), shape(4).alias("plan"), F.array(shape(2)).alias("parents"), F.array(root(3), root(4)).alias("parent_ids"),
        F.array_join(F.array_repeat(F.lit("s"), (F.col("o_custkey") % 7 + 1).cast("int")), "__").alias("problem_id"),
        F.element_at(F.array(F.lit("mutation"), F.lit("crossover"), F.lit("survivor")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "certified").otherwise("failed").alias("status"),
    )
    return detectors.raise_flags(rows).groupBy(F.array_join("flags", ",").alias("flags")).agg(F.count("*").alias("n"))


@query(r"""WITH h AS (SELECT c_custkey, 'A ' || CASE c_custkey % 4 WHEN 0 THEN 'parent of formal' WHEN 1 THEN 'LEAN operator' WHEN 2 THEN 'proof obligation' ELSE 'informal' END || ' statement' AS s FROM customer)
SELECT CASE c_custkey % 4 WHEN 0 THEN 'formal,parent' WHEN 1 THEN 'Lean,operator' WHEN 2 THEN 'proof obligation' ELSE '' END AS terms, count(*) AS n FROM h GROUP BY 1""")
def internal_terms(spark, sf_dir):
    said = F.element_at(F.array(F.lit("parent of formal"), F.lit("LEAN operator"), F.lit("proof obligation"), F.lit("informal")), (F.col("c_custkey") % 4 + 1).cast("int"))
    terms = families.internal_terms(F.concat(F.lit("A "), said, F.lit(" statement")))
    return table(spark, sf_dir, "customer").groupBy(F.array_join(terms, ",").alias("terms")).agg(F.count("*").alias("n"))
