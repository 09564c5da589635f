"""The registry of refusal flags, and the decisions that sets of flags lead to, as Column functions.

Flags are array<string>; a null array is empty. Status and kind are strings; null is the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Each flag with its category, in the order of the registry.
RULES = (
    ("projection_only_theorem", "surface_wrapper"),
    ("same_formal_statement_as_parent", "surface_wrapper"),
    ("syntactic_wrapper_only", "surface_wrapper"),
    ("parameter_shift_only_theorem", "direct_corollary_helper"),
    ("auxiliary_conjunct_only_theorem", "direct_corollary_helper"),
    ("trivial_negation_chain", "surface_wrapper"),
    ("trivial_add_zero_padding", "surface_wrapper"),
    ("typeclass_narrowing_only", "surface_wrapper"),
    ("divisibility_weaken_only_theorem", "direct_corollary_helper"),
    ("side_by_side_conjunction", "parent_crossover"),
    ("unused_checkpoint", "parent_crossover"),
    ("parent_checkpoint_not_consumed", "parent_crossover"),
    ("same_lineage_crossover", "parent_crossover"),
    ("mutation_like_crossover", "parent_crossover"),
    ("weak_inspiration_only_crossover", "parent_crossover"),
    ("indirect_parent_contribution", "parent_crossover"),
    ("concrete_native_decide_projection", "fixed_computation"),
    ("tautological_checkpoint_theorem", "direct_corollary_helper"),
    ("piecewise_branch_only_theorem", "fixed_computation"),
    ("fin_one_vacuity_theorem", "fixed_computation"),
    ("fin_one_concrete_arithmetic_theorem", "fixed_computation"),
    ("unit_product_closure_only", "direct_corollary_helper"),
    ("computational_crossover_only", "fixed_computation"),
    ("proof_infrastructure_only", "direct_corollary_helper"),
    ("direct_parent_corollary_only", "direct_corollary_helper"),
    ("linear_equation_shift_corollary_only", "direct_corollary_helper"),
    ("affine_index_drift_only", "domain_specific"),
    ("cardinality_only_window", "fixed_computation"),
    ("aggregate_helper_only", "direct_corollary_helper"),
    ("lineage_complexity_without_new_role", "direct_corollary_helper"),
    ("order_equality_selector_only", "direct_corollary_helper"),
    ("same_target_role_already_accepted", "direct_corollary_helper"),
    ("witness_packaging_only", "direct_corollary_helper"),
    ("coefficient_engineering_only", "direct_corollary_helper"),
    ("theorem_local_corollary_dominated", "direct_corollary_helper"),
    ("definitional_extensionality_only", "direct_corollary_helper"),
    ("pid_definition_restatement", "direct_corollary_helper"),
    ("standard_library_theorem_restatement", "direct_corollary_helper"),
    ("cyclic_transport_same_target_role", "domain_specific"),
    ("topology_direct_consequence_only", "direct_corollary_helper"),
    ("finite_residue_bookkeeping_only", "domain_specific"),
    ("ap_index_only_theorem", "domain_specific"),
    ("ap_shifted_local_corollary_only", "domain_specific"),
    ("ap_bound_padding_only", "domain_specific"),
    ("ap_interval_bound_padding_only", "domain_specific"),
    ("mod_inverse_same_conclusion_paraphrase", "domain_specific"),
    ("solved_parameter_quotient_corollary_only", "direct_corollary_helper"),
    ("mod_inverse_arithmetic_corollary_only", "direct_corollary_helper"),
    ("residue_finset_cardinality_restatement", "domain_specific"),
    ("finite_mod_inverse_window_restatement", "domain_specific"),
    ("fixed_finite_aggregate_computation", "fixed_computation"),
    ("cardinality_arithmetic_pipeline_only", "fixed_computation"),
    ("native_decide_fixed_domain_computation", "fixed_computation"),
    ("artificial_bridge_to_existing_pipeline", "domain_specific"),
    ("numeric_bound_fitting_crossover", "domain_specific"),
    ("parent_theorem_assumption_smuggling", "parent_crossover"),
    ("near_duplicate", "novelty_memory"),
    ("exact_duplicate_memory", "novelty_memory"),
)
FLAGS = tuple(flag for flag, _ in RULES)

#: Rules that misrepresent; all others change the meaning only on the surface.
MISREPRESENT = (
    "same_formal_statement_as_parent", "side_by_side_conjunction", "unused_checkpoint", "parent_checkpoint_not_consumed", "same_lineage_crossover",
    "mutation_like_crossover", "weak_inspiration_only_crossover", "indirect_parent_contribution", "parent_theorem_assumption_smuggling",
)

#: Signals of each kind of misformalisation, besides the rules, with the level and category they give, first kind first.
KINDS = (
    ("source", "reporting", ("axiom_backed_seed_or_child", "parent_proof_surface_missing", "proof_surface_unavailable", "invalid_parent_proof_surface", "missing_parent_proof_body")),
    ("translation", "syntactic", ("llm_json_parse_error", "invalid_formal_shape", "lean_syntax_error", "proof_contains_sorry", "theorem_generation_failed", "statement_typecheck_failed")),
    ("translation", "misrepresentation", (*MISREPRESENT, "statement_lean_alignment_failed", "alignment_failed", "missing_parent_contribution")),
    ("translation", "semantic", (*(f for f in FLAGS if f not in MISREPRESENT), "solution_modulus_mismatch", "solution_answer_mismatch", "solution_formula_mismatch", "informal_statement_internal_terms")),
    ("underspecified", "implicit_conventions", ("theorem_too_broad", "missing_formal_statement", "missing_proof_plan", "missing_quality_checkpoints", "unsupported_quality_claim", "unsupported", "numeric_template_unsupported")),
    ("source", "mathematical", ("proof_failed", "lean_type_check_failed", "lean_check_failed", "wrong_answer", "projection_params_mismatch", "projection_check_failed")),
)

#: Kinds of row that no generator made, and crossover flags that do not count as weak.
NOT_GENERATED = ("survivor", "fallback_survivor", "seed_proof_completion")
NOT_WEAK = ("sequential_composition", "same_role_crossover", "pipeline_composite", "lemma_bundle_master")

#: Flags with which a row is no harder than its parent.
DECREASE = (
    "same_formal_statement_as_parent", "same_statement_rephrase", "syntactic_wrapper_only", "projection_only_theorem", "trivial_negation_chain",
    "trivial_add_zero_padding", "typeclass_narrowing_only", "side_by_side_conjunction", "mutation_like_crossover", "weak_inspiration_only_crossover",
    "parent_checkpoint_not_consumed", "unused_checkpoint", "fin_one_vacuity_theorem", "fin_one_concrete_arithmetic_theorem",
    "tautological_checkpoint_theorem", "statement_lean_alignment_failed", "alignment_failed",
)

#: Flags that reject a row, and flags that leave it as scaffold.
REJECT = (
    "same_formal_statement_as_parent", "same_statement_rephrase", "formal_surface_not_changed", "syntactic_wrapper_only", "projection_only_theorem",
    "trivial_negation_chain", "trivial_add_zero_padding", "typeclass_narrowing_only", "side_by_side_conjunction", "mutation_like_crossover",
    "weak_inspiration_only_crossover", "parent_checkpoint_not_consumed", "unused_checkpoint", "same_lineage_crossover",
    "informal_statement_internal_terms", "statement_lean_alignment_failed", "alignment_failed", "exact_duplicate_memory", "near_duplicate",
)
SCAFFOLD = (
    "direct_parent_corollary_only", "ap_index_only_theorem", "ap_shifted_local_corollary_only", "ap_bound_padding_only",
    "ap_interval_bound_padding_only", "linear_equation_shift_corollary_only", "affine_index_drift_only", "cardinality_only_window",
    "aggregate_helper_only", "proof_infrastructure_only", "fixed_finite_aggregate_computation", "native_decide_fixed_domain_computation",
    "cardinality_arithmetic_pipeline_only", "mod_inverse_same_conclusion_paraphrase", "mod_inverse_arithmetic_corollary_only",
    "finite_mod_inverse_window_restatement", "finite_residue_bookkeeping_only", "residue_finset_cardinality_restatement",
    "solved_parameter_quotient_corollary_only", "theorem_local_corollary_dominated", "cyclic_transport_same_target_role",
    "topology_direct_consequence_only", "same_target_role_already_accepted", "witness_packaging_only", "coefficient_engineering_only",
)


def rules(spark: SparkSession) -> DataFrame:
    """The registry as a table of flag and category; its 58 rows may be broadcast."""
    return spark.createDataFrame(list(RULES), "flag string, category string")


def _set(names: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, names))


def _flags(flags: Column) -> Column:
    return F.coalesce(flags, F.array().cast("array<string>"))


def _any(flags: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(flags, _set(names))


def taxonomy(flags: Column, status: Column, failure: Column, summary: Column) -> Column:
    """Level, category and sorted signals of a row's misformalisation, the first of KINDS that has a signal; `none` without one."""
    end = F.when(~F.coalesce(status, F.lit("")).isin("", "certified", "survivor"), status)
    signals = F.array_sort(F.array_distinct(F.concat(_flags(flags), F.array_compact(F.array(F.nullif(failure, F.lit("")), end)))))
    said = F.lower(F.coalesce(summary, F.lit("")))
    hints = {"reporting": said.contains("axiom "), "syntactic": said.contains("syntax") | said.contains("parse")}
    level, category = F.lit("none"), F.lit("none")
    for at, name, names in reversed(KINDS):
        hit = _any(signals, names) | hints.get(name, F.lit(False))
        level, category = F.when(hit, at).otherwise(level), F.when(hit, name).otherwise(category)
    return F.struct(level.alias("level"), category.alias("category"), signals.alias("signals"))


def accepted_proxy(flags: Column, status: Column, kind: Column, theorem: Column, surface_changed: Column, has_surface: Column, parents_seen: Column) -> Column:
    """Sorted flags that keep a row from standing in for an accepted one; it passes if there are none.

    A crossover needs two parents seen in it. A theorem needs a surface of its own; surface_changed null is not measured.
    """
    status, kind, theorem = F.coalesce(status, F.lit("")), F.coalesce(kind, F.lit("")), F.coalesce(theorem, F.lit(False)) & ~F.coalesce(kind, F.lit("")).isin("survivor", "fallback_survivor")
    more = {
        "not_certified": status != "certified",
        "not_generated": kind.isin(*NOT_GENERATED),
        "formal_surface_not_changed": theorem & ~F.coalesce(surface_changed, F.lit(True)),
        "missing_theorem_surface": theorem & ~F.coalesce(has_surface, F.lit(False)),
        "crossover_parent_usage_not_observable": (kind == "crossover") & (F.coalesce(parents_seen, F.lit(0)) < 2),
    }
    raised = F.array_compact(F.array(*[F.when(c, name) for name, c in more.items()]))
    return F.array_sort(F.array_distinct(F.concat(F.array_except(_flags(flags), _set(NOT_WEAK)), raised)))


def entropy_direction(flags: Column, status: Column, surface_changed: Column, proxy: Column) -> Column:
    """`increase` where a certified row, or a survivor whose proxy passes, has a new surface and no flag of DECREASE; else `decrease`."""
    status = F.coalesce(status, F.lit(""))
    up = (status == "certified") | ((status == "survivor") & (F.size(proxy) == 0))
    return F.when(up & ~_any(_flags(flags), DECREASE) & F.coalesce(surface_changed, F.lit(True)), "increase").otherwise("decrease")


def curation(flags: Column, status: Column, kind: Column, proxy: Column, direction: Column) -> Column:
    """Class (paper, scaffold or reject) of a row, with the reason."""
    flags = _flags(flags)
    made = (F.coalesce(status, F.lit("")) == "certified") & ~F.coalesce(kind, F.lit("")).isin(*NOT_GENERATED)
    steps = (
        (~made, "reject", "not_a_generated_certified_candidate"),
        (_any(flags, REJECT), "reject", "hard_reject_flags"),
        (_any(flags, SCAFFOLD), "scaffold", "certified_scaffold_not_paper_grade"),
        ((F.size(proxy) == 0) & (direction != "decrease"), "paper", "accepted_proxy_pass"),
        (direction == "increase", "scaffold", "certified_entropy_increase_but_not_paper_grade"),
        (F.lit(True), "reject", "not_entropy_increasing_or_proxy_failed"),
    )
    return F.coalesce(*[F.when(c, F.struct(F.lit(k).alias("class"), F.lit(why).alias("reason"))) for c, k, why in steps])


def decide(df: DataFrame) -> DataFrame:
    """df (flags, status, kind, failure, summary, theorem, surface_changed, has_surface, parents_seen) with taxonomy, proxy, direction and curation."""
    c = F.col
    df = df.withColumn("taxonomy", taxonomy(c("flags"), c("status"), c("failure"), c("summary")))
    df = df.withColumn("proxy", accepted_proxy(c("flags"), c("status"), c("kind"), c("theorem"), c("surface_changed"), c("has_surface"), c("parents_seen")))
    df = df.withColumn("direction", entropy_direction(c("flags"), c("status"), c("surface_changed"), c("proxy")))
    return df.withColumn("curation", curation(c("flags"), c("status"), c("kind"), c("proxy"), c("direction")))


def slot_verdict(flags: Column, status: Column, judge: Column, coupled: Column) -> Column:
    """pass, weak or fail: a row that is not certified fails; a measured coupling (null is not measured) that is not there is weak whatever the judge says; then the judge counts, and without one the flags."""
    weak = F.size(F.array_except(_flags(flags), _set(NOT_WEAK))) > 0
    return F.when(F.coalesce(status, F.lit("")) != "certified", "fail").when(~F.coalesce(coupled, F.lit(True)), "weak").otherwise(F.coalesce(judge, F.when(weak, "weak").otherwise("pass")))


def slot_score(coverage: Column, flags: Column) -> Column:
    """Coverage less 0.15 for each weak flag, 0 at least, to two places."""
    weak = F.size(F.array_except(_flags(flags), _set(NOT_WEAK)))
    return F.greatest(F.lit(0.0), F.round(coverage - 0.15 * weak, 2))
