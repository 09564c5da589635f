"""Golden cases of the parts and outcomes of statements and proofs."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import proofs


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def text(s):
    return F.lit(s).cast("string")


@pytest.mark.parametrize(
    ("statement", "goal", "shape"),
    [
        ("theorem t (a : ℕ) : a ∣ 4 := by", "a ∣ 4", "divisibility"),
        ("theorem t {x : ℝ} (h : x := 2) : x < 3", "x < 3", "inequality"),
        ("theorem t : ∀ x : ℕ, p x", "∀ x : ℕ, p x", "universal"),
        ("a := 3", "a := 3", "equation"),
        ("plain", "plain", "other"),
        ("", "", "other"),
        (None, "", "other"),
    ],
)
def test_goal(spark, statement, goal, shape):
    assert value(spark, proofs.goal_of(text(statement))) == goal
    assert value(spark, proofs.goal_shape(text(statement))) == shape


def test_bounds(spark):
    child = "theorem t (k : ℕ) (h : k ≤ 100) (g : k > 5) (m : k < 12) : p -- (z : z < 77)\n := by simp"
    assert value(spark, proofs.literal_bounds(text(child))) == [12, 100]
    assert value(spark, proofs.introduced_bounds(text("theorem t (h : k < 12) : p"), text(child))) == [100]
    assert value(spark, proofs.literal_bounds(text("(h : k < " + "9" * 30 + ")"))) == []
    assert value(spark, proofs.literal_bounds(text(None))) == []


def test_prefix_and_header(spark):
    assert value(spark, proofs.theorem_prefix(text("theorem t : p :=\n by simp"))) == "theorem t : p :=\n by"
    assert value(spark, proofs.theorem_prefix(text(" theorem t : p := rfl "))) == "theorem t : p := by"
    assert value(spark, proofs.theorem_prefix(text(None))) == ""
    assert value(spark, proofs.header_of(text("import M\nopen N\n\nlemma t : p"))) == "import M\nopen N"
    assert value(spark, proofs.header_of(text("def f := 1"))) == ""
    strict = "set_option autoImplicit false"
    assert value(spark, proofs.strict_header(text("import M"))) == "import M\n" + strict
    assert value(spark, proofs.strict_header(text(strict + "\nopen N"))) == strict + "\nopen N"


def test_assemble(spark):
    put = lambda *a: value(spark, proofs.assemble(*map(text, a)))
    assert put("import M\n", "theorem t : p", "simp\n") == "import M\n\ntheorem t : p := by\n  simp\n"
    assert put("", "theorem t : p := by", "\n  simp") == "\n\ntheorem t : p := by\n  simp\n"
    assert put("import M", None, "simp") == ""


def test_metrics(spark):
    m = value(spark, proofs.proof_metrics(text("intro x -- cases\n\n· simp\n<;> omega\nsimp"), ("simp", "omega", "intro")))
    assert (m.n_steps, m.tactics, m.uses_induction, m.uses_cases) == (4, ["intro", "simp", "omega"], False, False)
    assert value(spark, proofs.proof_metrics(text(None), ("simp",))).n_steps == 0


def test_unescape(spark):
    assert value(spark, proofs.unescape(text("x \\\\in \\\\mathbb{R}, \\u03b2 \\\\u03B2 \\\\ 3"))) == "x \\in \\mathbb{R}, \u03b2 \u03b2 \\\\ 3"
    assert value(spark, proofs.unescape(text(None))) == ""


def test_sorry_and_kinds(spark):
    assert value(spark, proofs.has_sorry(text("by sorry"))) and not value(spark, proofs.has_sorry(text("by simp -- sorry")))
    assert value(spark, proofs.error_kind(text("UNKNOWN IDENTIFIER after timeout"))) == "unknown_identifier"
    assert value(spark, proofs.error_kind(text(None))) == "other"
    assert value(spark, proofs.relation(F.lit(None).cast("boolean"), F.lit(True))) == "child_stronger"


def test_an_empty_reply_after_attempts_is_no_empty_episode(spark):
    schema = "success boolean, statement_invalid boolean, verifier_failed boolean, generator_empty boolean, n_attempts int, tokens_used int, token_budget int, sampled_batches int, actions int, n_steps int"
    rows = [(None, None, None, True, 3, 50, 100, None, None, None), (None, None, None, True, 0, 0, 100, None, None, None), (None,) * 10, (False, False, False, False, None, 0, 0, 4, 9, 0)]
    got = [r.x for r in spark.createDataFrame(rows, schema).select(proofs.episode_outcome(F.struct("*"), 9).alias("x")).collect()]
    assert got == ["attempts_exhausted", "generator_empty", "sampler_empty", "action_budget"]
