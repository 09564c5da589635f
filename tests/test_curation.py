"""Golden cases of detectors, decisions and number families."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import detectors, families, policy

ROW = "statement string, formal string, lean string, plan string, parents array<string>, kind string, status string"


def flags_of(spark, **row):
    row = {"statement": None, "formal": None, "lean": None, "plan": None, "parents": None, "kind": "mutation", "status": "certified"} | row
    return detectors.raise_flags(spark.createDataFrame([tuple(row[n.split()[0]] for n in ROW.split(", "))], ROW)).first().flags


CASES = [
    ({"statement": "The second component of p and q"}, ["projection_only_theorem"]),
    ({"formal": "theorem t (h : a ∧ b) : a", "lean": "exact h.1"}, ["projection_only_theorem"]),
    ({"statement": "3 divides x, as 24 | x, divisibility", "plan": "unpack 24 divisibility"}, ["divisibility_weaken_only_theorem"]),
    ({"statement": "n = n"}, ["tautological_checkpoint_theorem"]),
    ({"statement": "the solution is = 0 if n = 3"}, ["piecewise_branch_only_theorem"]),
    ({"formal": "theorem t : x + 0 < y"}, ["trivial_add_zero_padding"]),
    ({"plan": "Simpa only, same conclusion"}, ["syntactic_wrapper_only"]),
    ({"formal": "theorem t : Matrix.det (m : Fin 1) < 3", "plan": "one-by-one"}, ["fin_one_concrete_arithmetic_theorem"]),
    ({"formal": "theorem t : long_goal a ∧ long_goal b", "parents": ["theorem p : long_goal a", "theorem q : long_goal b"], "kind": "crossover"}, ["side_by_side_conjunction"]),
    ({"formal": "theorem t : long_goal a ∧ long_goal b", "parents": ["theorem p : long_goal a"], "kind": "crossover"}, []),
    ({"formal": "theorem t : a ∧ b", "plan": "Side by side", "kind": "crossover"}, ["side_by_side_conjunction"]),
    ({"statement": "x < y"}, []),
    ({}, []),
]


@pytest.mark.parametrize(("row", "want"), CASES)
def test_detectors(spark, row, want):
    assert flags_of(spark, **row) == want


def test_crossover_is_not_held_to_mutation_rules(spark):
    same = {"formal": "theorem t [Field R] : goal 1", "parents": ["theorem p [Ring R] : goal 1"]}
    assert flags_of(spark, **same) == ["typeclass_narrowing_only"]
    assert flags_of(spark, **same, kind="crossover") == []


def decide(spark, flags, **over):
    row = {"flags": flags, "status": "certified", "kind": "mutation", "failure": "", "summary": "", "theorem": True, "surface_changed": True, "has_surface": True, "parents_seen": 2} | over
    schema = "flags array<string>, status string, kind string, failure string, summary string, theorem boolean, surface_changed boolean, has_surface boolean, parents_seen int"
    return policy.decide(spark.createDataFrame([tuple(row.values())], schema)).first()


def test_decisions(spark):
    assert decide(spark, []).curation["class"] == "paper"
    assert decide(spark, None).curation["class"] == "paper"
    assert decide(spark, ["near_duplicate", "ap_index_only_theorem"]).curation.reason == "hard_reject_flags"
    assert decide(spark, ["ap_index_only_theorem"]).curation["class"] == "scaffold"
    assert decide(spark, ["lemma_bundle_master"], kind="crossover").proxy == []
    assert decide(spark, [], kind="crossover", parents_seen=1).proxy == ["crossover_parent_usage_not_observable"]
    assert decide(spark, [], surface_changed=False).direction == "decrease"
    assert decide(spark, [], surface_changed=None).direction == "increase"
    assert decide(spark, [], status=None).curation.reason == "not_a_generated_certified_candidate"


def test_taxonomy_takes_the_first_kind(spark):
    assert decide(spark, ["proof_failed", "near_duplicate"]).taxonomy.category == "semantic"
    assert decide(spark, ["near_duplicate"], summary="Syntax error").taxonomy.category == "syntactic"
    assert decide(spark, [], status="proof_failed").taxonomy.level == "source"
    assert decide(spark, []).taxonomy.category == "none"


def test_registry(spark):
    assert len(set(policy.FLAGS)) == 58 and policy.rules(spark).count() == 58


def test_number_families_against_plain_arithmetic(spark):
    rows = [(a, b) for a in (0, 1, 2, 12, 97, 360, 1009) for b in (1, 6, 36, 97)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select("a", "b", families.gcd(F.col("a"), F.col("b")).alias("g"), families.n_primes(F.col("a")).alias("pf"), families.n_divisors(F.col("a")).alias("tau"), families.divisor_sum(F.col("a")).alias("s"), families.is_prime(F.col("a")).alias("p"), families.last_digit(F.col("b"), F.col("a")).alias("d"), families.choose(F.col("b"), F.lit(3).cast("long")).alias("c"))
    for r in got.collect():
        ds = [d for d in range(1, r.a + 1) if r.a % d == 0]
        primes = [d for d in ds if d > 1 and all(d % e for e in range(2, d))]
        assert (r.g, r.pf, r.tau, r.s, r.p) == (math.gcd(r.a, r.b), len(primes), len(ds), sum(ds), r.a in primes)
        assert (r.d, r.c) == (pow(r.b, r.a, 10), math.comb(r.b, 3))


def test_large_numbers_are_factored(spark):
    """Squares and products of primes over 2 ** 31, a sum of divisors that does not fit bigint, and numbers that are none."""
    q = 2147483647
    said = [(q * q, 3, 1, 1 + q + q * q), (1000003 * 1000033, 4, 2, 1000004 * 1000034), (2**62, 63, 1, 2**63 - 1), (2**63 - 1, 96, 6, None), (1, 1, 0, 1), (0, 0, 0, 0), (-4, None, None, None), (None, None, None, None)]
    x = F.col("n")
    got = spark.createDataFrame([(r[0],) for r in said], "n long").select("n", families.n_divisors(x), families.n_primes(x), families.divisor_sum(x)).collect()
    assert [tuple(r) for r in got] == said


@pytest.mark.parametrize(("text", "want"), [("answer is 3, so is 5", 5), ("\\boxed{7} from 2", 7), ("first 1 then -4", -4), ("none", None), (None, None)])
def test_claimed_answer(spark, text, want):
    assert spark.range(1).select(families.claimed_answer(F.lit(text).cast("string")).alias("x")).first().x == want
