"""Predicates that rows pass or fail. Null is not passed, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions.parse import is_stub, without_comments

#: What no tactic may have.
BANNED = ("sorry", "admit", "axiom ", "unsafe ", "run_cmd", "#eval")


def in_split(value: Column, keep: list[str]) -> Column:
    return F.coalesce(value.cast("string").isin(*keep), F.lit(False))


def in_range(value: Column, low=None, high=None) -> Column:
    """Between bounds, of which either may be missing."""
    ok = value.isNotNull()
    return ok & (F.lit(True) if low is None else F.coalesce(value >= low, F.lit(False))) & (F.lit(True) if high is None else F.coalesce(value <= high, F.lit(False)))


def is_redundant(*evidence: Column) -> Column:
    """Some list of evidence has something in it."""
    out = F.lit(False)
    for e in evidence:
        out = out | (F.coalesce(F.size(e), F.lit(0)) > 0)
    return out


def has_candidates(kind: Column, steps: Column) -> Column:
    """Searches have a candidate in some step (array of struct with candidates); other runs need none."""
    return (kind != "search") | F.coalesce(F.exists(steps, lambda s: F.coalesce(F.size(s["candidates"]), F.lit(0)) > 0), F.lit(False))


def has_system_error(tree: Column) -> Column:
    """A JSON tree whose text has a `system_error` that is plainly not null, false, 0 or empty: a quick test inside the row. operators.trees walks the tree, and decides."""
    return F.coalesce(tree.rlike(r'"system_error"\s*:\s*(true|[1-9]|-|"[^"]|\{\s*"|\[\s*[^\]\s])'), F.lit(False))


def is_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z_][A-Za-z0-9_'.]*$"), F.lit(False))


def is_buggy(tactic: Column) -> Column:
    """A tactic with something banned, or a hole that is not refine's."""
    banned = F.lit(False)
    for mark in BANNED:
        banned = banned | tactic.contains(mark)
    return F.coalesce(banned | (tactic.contains("?_") & ~tactic.rlike(r"\brefine\b")), F.lit(True))


def is_trusted(prefix: Column) -> Column:
    """A formal prefix that declares no axiom, comments aside."""
    return ~without_comments(prefix).rlike(r"(?m)^\s*(private |protected )?axiom\s")


def passes_stub_test(code: Column) -> Column:
    return ~is_stub(code)
