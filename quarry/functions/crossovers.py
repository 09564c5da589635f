"""What kind of crossover a child is, and whether its parents are in it, by its parameters and by what it says of them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words by which a contribution claims what a parent comes to, and the mechanism that only puts steps one after another.
OUTPUTS = ("answer", "gcd", "divisor", "remainder", "modulus", "sum")
SEQUENTIAL = "sequential_composition"


def indirect(child: Column, parents: Column) -> Column:
    """Ids of the parents of another family that are not in the child's parameters: the answer of one whose output is claimed, else any of its parameters.

    child: struct of family, params (map of numbers), claims (map of parent to text); parents: array of (id, family, answer, params).
    """
    values = F.map_values(child["params"])
    claims = lambda p: F.exists(F.array(*map(F.lit, OUTPUTS)), lambda w: F.contains(F.lower(F.coalesce(F.element_at(child["claims"], p["id"]), F.lit(""))), w))
    there = lambda p: F.when(p["answer"].isNotNull() & claims(p), F.array_contains(values, p["answer"])).otherwise(F.arrays_overlap(F.map_values(p["params"]), values))
    return F.transform(F.filter(parents, lambda p: (p["family"] != child["family"]) & ~F.coalesce(there(p), F.lit(False))), lambda p: p["id"])


def kind(claims: Column, roles: Column, mechanism: Column, why_apart: Column) -> Column:
    """pipeline_composite: steps in sequence, or no word of why it is more; true_fusion: both parents contribute in different roles; pipeline_composite if in one role; else mutation_like."""
    said = F.size(F.filter(F.map_values(claims), lambda c: F.trim(c) != "")) >= 2
    apart = F.size(F.array_distinct(F.filter(F.map_values(roles), lambda r: r != ""))) >= 2
    sequence = (F.coalesce(mechanism, F.lit("")) == SEQUENTIAL) | (F.trim(F.coalesce(why_apart, F.lit(""))) == "")
    return F.when(sequence, "pipeline_composite").when(said & apart, "true_fusion").when(said, "pipeline_composite").otherwise("mutation_like")


def flags(child: Column, parents: Column, roles: Column, mechanism: Column, why_apart: Column) -> Column:
    """Sorted flags of a crossover that these two tests raise."""
    found = F.array(F.when(kind(child["claims"], roles, mechanism, why_apart) == "mutation_like", "mutation_like_crossover"), F.when(F.size(indirect(child, parents)) > 0, "indirect_parent_contribution"))
    return F.array_sort(F.array_compact(found))
