"""Detectors of formal statements that say too little: a table of rules, and one evaluator that makes Columns of it.

A row has statement, formal, lean and plan (strings), kind (mutation, crossover or survivor), status, and parents, an array of
parents' formal statements; it may have problem_id, parent_ids and evidence. Null strings are empty, null arrays are empty. Patterns are
looked for in lower-case text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

#: Parts of a row that rules look at, by the fields that are joined for each. `stated` is formal, or lean where that is empty;
#: `tight` is text without white space, `goal` what formal comes to after its last colon and arrow, `parents` all parents' statements.
PARTS = {
    "text": ("statement", "formal", "lean", "plan"),
    "said": ("statement", "formal", "plan"),
    "proof": ("plan", "lean"),
    "code": ("formal", "lean"),
    "lean": ("lean",),
    "formal": ("formal",),
    "evidence": ("evidence", "plan"),
}


@dataclass(frozen=True)
class Rule:
    """flag is raised where each pattern of needs, and none of lacks, is found in the part it is for; kind and certified restrict the rows."""

    flag: str
    needs: tuple[tuple[str, str], ...]
    lacks: tuple[tuple[str, str], ...] = ()
    kind: str | None = None
    certified: bool = False


_PROGRESSION = r"arithmetic (progression|sequence)|\ba\s*\+\s*\d*\s*\*?\s*d\b|\bap\b"
_PRIME = r"\bprime|divisor"
_RESIDUE = r"%\s*8\b|mod 8\b"
_WINDOW = r"window|interval|icc|range"
_PADDING = r"padding|slack|weaker bound"
_ROLE = r"uniqu|∃!|if and only if|↔|classif|new role"

#: What each flag looks for.
RULES = (
    Rule("fin_one_vacuity_theorem", (("text", "fin 1"), ("text", r"vacuous|subsingleton\.elim|no distinct|cannot be distinct"))),
    Rule("fin_one_concrete_arithmetic_theorem", (("text", "fin 1"), ("text", r"matrix\.det"), ("text", r"digits \d through|one-by-one|normalize each fin 1|constant integer entries"))),
    Rule("syntactic_wrapper_only", (("text", r"wrapper|by simpa|simpa only"), ("text", r"same (theorem|conclusion)|unchanged conclusion|without new obligation"))),
    Rule("concrete_native_decide_projection", (("code", "native_decide"), ("code", r"\bdivisors\s+\d+\b|\b\d+\s*[+*^%]\s*\d+\b"))),
    Rule("tautological_checkpoint_theorem", (("said", r"\bn = n\b|reflexive"),)),
    Rule("tautological_checkpoint_theorem", (("text", r"\bh\w*\s*:\s*[^:]+=\s*24"), ("stated", "24 ∣"), ("lean", r"(rw|simpa|simp) \[h"))),
    Rule("piecewise_branch_only_theorem", (("said", "solution"), ("said", "= 0"), ("said", r"zero.branch|n = [34]\b|if n ="))),
    Rule("trivial_negation_chain", (("tight", r"-\(-"),)),
    Rule("trivial_negation_chain", (("text", r"neg_neg|negation wrapper|(double|triple) negation"),)),
    Rule("trivial_add_zero_padding", (("tight", r"\+0|0\+"),)),
    Rule("trivial_add_zero_padding", (("text", "add_zero|zero padding"),)),
    Rule("projection_only_theorem", (("text", r"project(ed from| the)|(first|second) component|\b[a-z_]\w*\.[12]\b"), ("text", "∧| and |prime"))),
    Rule("divisibility_weaken_only_theorem", (("text", "divi(s|d)|∣"), ("text", "24"), ("text", r"\b[348]( : ℤ\))?\s*(∣|divides)"), ("proof", r"unpack|exhibit|quotient|24 divides|24\s*\*\s*k"))),
    Rule("unit_product_closure_only", (("text", "isunit"), ("text", r"\*"), ("text", r"\.mul|closure|products? of units|unit product")), (("text", r"orderof|exists|∃|irreducible|tendsto"),), "mutation", True),
    Rule("computational_crossover_only", (("text", "native_decide"),), kind="crossover"),
    # what certified mutations and crossovers of single domains come to
    Rule("proof_infrastructure_only", (("text", _PRIME), ("text", "divisor"), ("text", r"\b500\b"), ("text", "helper|auxiliary|infrastructure")), kind="mutation", certified=True),
    Rule("direct_parent_corollary_only", (("text", _PROGRESSION), ("text", r"\bindex|\bterm|\bsum")), (("text", _PRIME),), "mutation", True),
    Rule("linear_equation_shift_corollary_only", (("parents", r"\d+\s*\*\s*\w+\s*[+-]\s*\d+\s*=\s*\d+"), ("goal", r"^\w+\s*[+-]\s*\d+\s*=\s*-?\d+"), ("text", "nearby|linarith")), kind="mutation", certified=True),
    Rule("affine_index_drift_only", (("text", _PROGRESSION), ("text", _PRIME), ("text", r"\bn\s*[+-]\s*\d+|shifted index|index shift")), (("text", r"card.*sum|sum.*card"),), "crossover", True),
    Rule("cardinality_only_window", (("text", _PROGRESSION), ("text", _PRIME), ("text", "card"), ("text", _WINDOW)), (("text", "sum"),), "crossover", True),
    Rule("order_equality_selector_only", (("text", "orderof"), ("text", "select|choose"), ("text", "irrational")), kind="crossover", certified=True),
    Rule("same_target_role_already_accepted", (("text", "orderof"), ("text", "unit"), ("text", "neg|inverse|⁻¹"), ("goal", r"orderof.*=\s*orderof")), (("goal", "∀.*∣|16 ∣|odd"),), certified=True),
    Rule("witness_packaging_only", (("text", "gaussian|zsqrtd"), ("text", r"witness|⟨|\buse\b"), ("goal", "∃|∣")), certified=True),
    Rule("coefficient_engineering_only", (("text", "irrational"), ("text", "coefficient"), ("goal", r"\*")), (("goal", "∀ q"),), certified=True),
    Rule("theorem_local_corollary_dominated", (("goal", r"%\s*10\b"), ("text", r"20\s*∣\s*k"), ("text", r"k\s*\^\s*2\s*\+\s*2\s*\^\s*k")), (("goal", "∃|∀"),), certified=True),
    Rule("definitional_extensionality_only", (("formal", "finset|finite set"), ("goal", "="), ("formal", "∈|mem"), ("lean", r"\bext\b")), certified=True),
    Rule("pid_definition_restatement", (("text", r"principal ?ideal|\bpid\b"), ("text", "generator|span"), ("lean", "constructor|refine|⟨")), certified=True),
    Rule("standard_library_theorem_restatement", (("text", "rootset|natdegree|separable"), ("goal", "↔"), ("lean", r"exact \w+\.\w+")), (("text", "checkpoint"),), "mutation", True),
    Rule("ap_index_only_theorem", (("text", _PROGRESSION), ("text", "hidden"), ("goal", r"^a\s*\(?\s*\d+")), (("text", "∀|closed form"),), "mutation", True),
    Rule("ap_shifted_local_corollary_only", (("text", _PROGRESSION), ("text", "hidden|shift"), ("text", "local|adjacent|next term"), ("goal", r"\(\s*n\s*[+-]\s*\d+\s*\)|[+-]\s*\d+\s*\*\s*d\b")), kind="mutation", certified=True),
    Rule("ap_bound_padding_only", (("parents", _PROGRESSION), ("goal", "≤"), ("goal", r"a\s*\+\s*20\s*\*\s*d"), ("text", _PADDING)), (("text", _ROLE),), "mutation", True),
    Rule("ap_interval_bound_padding_only", (("parents", _PROGRESSION), ("goal", r"≤.*∧.*≤|icc"), ("text", _PADDING)), (("text", _ROLE),), "mutation", True),
    Rule("mod_inverse_same_conclusion_paraphrase", (("text", r"\b398\b"), ("text", r"\*\s*7\b"), ("goal", r"n\s*/\s*\w+\s*=\s*57"), ("text", "%|modulo|quotient")), kind="mutation", certified=True),
    Rule("solved_parameter_quotient_corollary_only", (("text", r"\b398\b"), ("text", r"\*\s*7\b"), ("text", r"\bn = 57\b"), ("goal", r"n\s*/\s*\d+\s*=\s*\d+")), kind="mutation", certified=True),
    Rule("mod_inverse_arithmetic_corollary_only", (("text", r"\b398\b"), ("text", r"\*\s*7\b"), ("goal", r"n\s*%\s*19\s*=\s*0|19\s*∣\s*n|n = 57")), kind="mutation", certified=True),
    Rule("residue_finset_cardinality_restatement", (("text", _RESIDUE), ("goal", r"3\s*\^\s*n\s*%\s*8\s*=\s*1|card\s*=\s*4|\bn = 4\b")), (("goal", "sum|prod"),), certified=True),
    Rule("finite_mod_inverse_window_restatement", (("parents", r"\b398\b"), ("text", r"\*\s*7\b"), ("text", _WINDOW), ("text", "known remainder|same inverse|repeats")), (("text", _ROLE),), "mutation", True),
    Rule("fixed_finite_aggregate_computation", (("text", _RESIDUE), ("goal", r"\.(sum|prod|card)\b"), ("lean", "native_decide|explicit set")), certified=True),
    Rule("cardinality_arithmetic_pipeline_only", (("text", r"divisors.*card|card.*divisors"), ("text", _RESIDUE), ("goal", r"card.*[+*-]|[+*-].*card")), (("text", _ROLE),), certified=True),
    Rule("native_decide_fixed_domain_computation", (("lean", "native_decide"), ("formal", r"finset\.(range|icc)|\bdivisors \d|\bfin \d")), (("text", "∀|symbolic"),), certified=True),
    Rule("artificial_bridge_to_existing_pipeline", (("text", _PROGRESSION), ("text", "bridge"), ("text", r"n\s*<\s*398"), ("text", r"%|mod")), kind="crossover", certified=True),
    Rule("numeric_bound_fitting_crossover", (("text", _PROGRESSION), ("text", r"132\s*\+\s*n\s*/\s*19")), kind="crossover", certified=True),
    Rule("parent_theorem_assumption_smuggling", (("formal", r"\(h\w*\s*:\s*∀"), ("lean", r"\b(exact|apply)\s+h"), ("text", _PRIME)), kind="crossover", certified=True),
    # what a crossover's own account says of its parents
    Rule("weak_inspiration_only_crossover", (("evidence", "inspired|capped|loosely|motivat"),), kind="crossover"),
)

#: A stronger class of a child beside the weaker one of its parent.
NARROWED = (("[commring", "[ring"), ("[linearorderedring", "[ring"), ("[field", "[divisionring"), ("[field", "[ring"), ("[commgroup", "[group"))

#: How a crossover says that it puts its parents side by side, how it passes one through, and tactics that settle a changed number by computing.
SIDE_BY_SIDE = r"side.by.side|independent conjunction|prove both parent theorems"
PASSED_THROUGH = "pass.through|carried along|not used"
MECHANICAL = "decide|norm_num|linarith"


def bare_surface(formal: Column) -> Column:
    """A statement before its proof, with a blank for its name, on one line, in lower case."""
    cut = F.substring_index(F.coalesce(formal, F.lit("")), ":= by", 1)
    named = F.regexp_replace(cut, r"\b(theorem|lemma)\s+[A-Za-z0-9_'.]+", "$1 _")
    return F.lower(F.trim(F.regexp_replace(named, r"\s+", " ")))


def blank_numbers(surface: Column) -> Column:
    return F.regexp_replace(surface, r"\b\d+\b", "#")


def conclusion(surface: Column) -> Column:
    """What follows the last colon of a bare surface; all of it without one."""
    return F.trim(F.substring_index(surface, ":", -1))


def final_goal(surface: Column) -> Column:
    """The conclusion after its last arrow."""
    return F.trim(F.substring_index(F.substring_index(conclusion(surface), "→", -1), "->", -1))


def _strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def parts() -> dict[str, Column]:
    """What rules look at, in lower case."""
    field = lambda name: F.coalesce(F.col(name), F.lit(""))
    out = {name: F.lower(F.concat_ws(" ", *map(field, fields))) for name, fields in PARTS.items()}
    out["stated"] = F.lower(F.coalesce(F.nullif(F.col("formal"), F.lit("")), F.col("lean"), F.lit("")))
    out["tight"] = F.regexp_replace(out["text"], r"\s+", "")
    out["goal"] = final_goal(bare_surface(F.col("formal")))
    out["parents"] = F.lower(F.concat_ws(" ", _strings("parents")))
    return out


def of_rule(rule: Rule, part: dict[str, Column]) -> Column:
    """The rule's condition; what is cheap comes first, as the rest is then not looked at."""
    terms = [F.col("kind") == rule.kind] if rule.kind else []
    if rule.certified:
        terms.append((F.col("status") == "certified") & (F.col("kind") != "survivor"))
    return reduce(and_, terms + [part[p].rlike(x) for p, x in rule.needs] + [~part[p].rlike(x) for p, x in rule.lacks])


def roots(ids: Column) -> Column:
    """The distinct first parts of lineage ids."""
    return F.array_distinct(F.transform(ids, lambda x: F.regexp_extract(x, r"^(.*?)(__|$)", 1)))


def tokens(text: Column) -> Column:
    """Distinct identifiers of three characters or more, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z_][a-z0-9_']{2,}"), F.lit(0)))


def against_parents(part: dict[str, Column]) -> dict[str, Column]:
    """Detectors that hold a mutation or crossover against its parents. Reads what raise_flags makes first."""
    own, parents = F.col("__own"), F.col("__parents")
    goal, certified = F.col("__goal"), (F.col("status") == "certified") & (F.col("__own") != "")
    mutation, crossover = (F.col("kind") == "mutation") & certified, (F.col("kind") == "crossover") & certified
    joined = goal.rlike("∧| and ")
    held = lambda p: (F.length(p["goal"]) >= 8) & goal.contains(p["goal"])
    narrowed = lambda p: reduce(or_, [own.contains(s) & p["own"].contains(w) for s, w in NARROWED])
    # a parent is consumed if the proof has a word of its conclusion
    met = lambda words: lambda p: F.arrays_overlap(p["words"], F.col(words))
    consumed, reached = F.filter(parents, met("__lean_words")), F.filter(parents, met("__goal_words"))
    depth = F.size(F.split(F.coalesce(F.col("problem_id"), F.lit("")), "__"))
    return {
        "same_formal_statement_as_parent": (own != "") & F.exists(parents, lambda p: p["own"] == own),
        "parameter_shift_only_theorem": mutation & F.exists(parents, lambda p: p["blank"] == blank_numbers(own)) & part["proof"].rlike(MECHANICAL),
        "auxiliary_conjunct_only_theorem": mutation & joined & F.exists(parents, held),
        "typeclass_narrowing_only": mutation & (goal != "") & F.exists(parents, lambda p: (p["goal"] == goal) & narrowed(p)),
        "side_by_side_conjunction": crossover & joined & ((F.size(F.filter(parents, held)) >= 2) | part["text"].rlike(SIDE_BY_SIDE)),
        "parent_checkpoint_not_consumed": crossover & (part["lean"] != "") & (F.size(consumed) < F.least(F.lit(2), F.size(parents))),
        "unused_checkpoint": crossover & part["proof"].rlike(PASSED_THROUGH) & (F.size(F.array_except(consumed, reached)) > 0),
        "same_lineage_crossover": (F.col("kind") == "crossover") & (F.size(roots(_strings("parent_ids"))) < F.size(_strings("parent_ids"))),
        "lineage_complexity_without_new_role": certified & (((F.col("kind") == "mutation") & (depth >= 5)) | ((F.col("kind") == "crossover") & (depth >= 6))) & ~part["text"].rlike(_ROLE),
    }


def detectors(part: dict[str, Column]) -> dict[str, Column]:
    """Each flag with its condition."""
    out = against_parents(part)
    for rule in RULES:
        found = of_rule(rule, part)
        out[rule.flag] = out[rule.flag] | found if rule.flag in out else found
    return out


#: Flags whose conditions go into one expression; all in one are too much for the compiler of a stage.
TOGETHER = 12


def raise_flags(df: DataFrame) -> DataFrame:
    """df with flags, the sorted names of the detectors that hold; those that are null do not."""
    names = df.columns
    for name, kind in (("problem_id", "string"), ("evidence", "string"), ("parent_ids", "array<string>")):
        if name not in names:
            df = df.withColumn(name, F.lit(None).cast(kind))
    spark, inner = df.sparkSession, {name: f"__x_{name}" for name in parts()}
    if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # few large pieces of input would leave most cores idle
        df = df.repartition(spark.sparkContext.defaultParallelism)
    # what many conditions look at is made once to a row, in columns of its own
    seen = df.withColumns({inner[name]: c for name, c in parts().items()} | {"__own": bare_surface(F.col("formal")), "__bare": F.transform(_strings("parents"), bare_surface)})
    ends = F.transform("__bare", lambda p: F.struct(p.alias("own"), conclusion(p).alias("goal"), blank_numbers(p).alias("blank"), tokens(conclusion(p)).alias("words")))
    seen = seen.withColumns({"__parents": ends, "__goal": conclusion(F.col("__own")), "__lean_words": tokens(F.col(inner["lean"])), "__goal_words": tokens(F.col(inner["goal"]))})
    found = [F.when(c, name) for name, c in detectors({name: F.col(c) for name, c in inner.items()}).items()]
    lots = {f"__flags_{i}": F.array_compact(F.array(*found[i : i + TOGETHER])) for i in range(0, len(found), TOGETHER)}
    flagged = seen.withColumns(lots).withColumn("flags", F.array_sort(F.flatten(F.array(*map(F.col, lots)))))
    return flagged.select(*[c for c in names if c != "flags"], "flags")
