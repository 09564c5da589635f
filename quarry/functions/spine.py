"""The steps of a proof as a graph, what its end rests on, and how deep down its parents meet. Columns only: each proof is closed up inside its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from quarry.functions.parse import all_of, without_comments

_NAME = r"[A-Za-z_][A-Za-z0-9_']*"
#: Fixed value: names that a proof cites from a library are dotted and begin with a capital.
CITED = r"\b[A-Z][A-Za-z0-9]*(?:\.[A-Za-z_][A-Za-z0-9_']*)+"


def bare(type_: Column) -> Column:
    """A type without white space and without its binders."""
    return F.regexp_replace(F.regexp_replace(type_, r"\s+", ""), rf"[({{\[]{_NAME}:[^)}}\]]*[)}}\]]", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is made once, however often body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def steps(code: Column) -> Column:
    """array of (name, type, text, uses): what `have name : type := text` introduces; uses are the other steps that the text names, before or after it. A name that is introduced again stands for its last step."""
    blocks = F.filter(F.slice(F.split(without_comments(code), r"(?m)^\s*have\s+"), 2, 1_000_000), lambda b: b.rlike(rf"(?s)^{_NAME}\s*:(?!=).*?:="))
    each = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, rf"^({_NAME})", 1).alias("name"), bare(F.regexp_extract(b, rf"(?s)^{_NAME}\s*:(.*?):=", 1)).alias("type"), F.regexp_replace(b, r"(?s)^.*?:=", "").alias("text")))
    last = let(each, lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda y: y["name"] == x["name"])))
    named = F.struct(last.alias("steps"))
    used = lambda x, names: F.array_remove(F.array_intersect(all_of(x["text"], _NAME), names), x["name"])
    whole = lambda found, names: F.transform(found, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["text"].alias("text"), used(x, names).alias("uses")))
    return let(named, lambda s: let(s["steps"]["name"], lambda names: whole(s["steps"], names)))


def closing(code: Column) -> Column:
    """The proof from its last step on, or the whole of it where it has none."""
    bare_code = without_comments(code)
    return F.element_at(F.split(bare_code, rf"(?m)^\s*have\s+(?={_NAME}\s*:(?!=)[\s\S]*?:=)"), -1)


def reach(graph: Column) -> Column:
    """map of a step's name to all steps that it rests on, itself included. graph: of steps.

    Every round joins what is reached by two stretches, so that log2 of the number of steps is enough; cycles reach no more than their members.
    """
    start = F.map_from_entries(F.transform(graph, lambda x: F.struct(x["name"], F.array_union(F.array(x["name"]), x["uses"]))))
    further = lambda m, _: F.transform_values(m, lambda k, names: F.array_distinct(F.flatten(F.transform(names, lambda n: F.element_at(m, n)))))
    # stretches of 1 to begin with, and of size - 1 at most
    n = F.ceil(F.log2(F.greatest(F.size(graph) - 1, F.lit(1)))).cast("int")
    rounds = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, further)


def spine(graph: Column, end: Column, reached: Column) -> Column:
    """Sorted types of the steps that the end of the proof rests on, one for each step. reached: of reach(graph)."""
    names = F.array_intersect(all_of(end, _NAME), graph["name"])
    all_names = let(reached, lambda r: F.array_distinct(F.flatten(F.transform(names, lambda n: F.element_at(r, n)))))
    return let(all_names, lambda a: F.array_sort(F.transform(F.filter(graph, lambda x: F.array_contains(a, x["name"])), lambda x: x["type"])))


def spine_changed(parent: Column, child: Column) -> Column:
    """If a child's spine lacks a step of its parent's or has one of its own; null where either is empty."""
    kept = F.size(F.filter(child, lambda t: F.array_contains(parent, t)))
    return F.when((F.size(parent) > 0) & (F.size(child) > 0), (kept < F.size(parent)) | (F.size(child) > kept))


def owners(graph: Column, parents: Column) -> Column:
    """map of a step's name to the parent that it comes from. parents: array of (key, conclusion, cited).

    A step that states a parent's conclusion is that parent's, by the order of the parents; one that cites a library name of only one parent is that one's. Others have none.
    """

    def owner(x: Column, parents: Column, cited: Column) -> Column:
        states = F.filter(parents, lambda p: (p["conclusion"] == x["type"]) & (x["type"] != ""))
        citing = F.array_distinct(F.transform(F.filter(parents, lambda p: F.arrays_overlap(p["cited"], cited)), lambda p: p["key"]))
        return F.coalesce(F.get(states, F.lit(0))["key"], let(citing, lambda keys: F.when(F.size(keys) == 1, F.get(keys, F.lit(0)))))

    each = lambda all_, x: F.struct(x["name"].alias("name"), let(all_of(x["text"], CITED), lambda cited: owner(x, all_, cited)).alias("key"))
    found = let(parents, lambda all_: F.filter(F.transform(graph, lambda x: each(all_, x)), lambda x: x["key"].isNotNull()))
    return F.map_from_entries(found)


def coupling(graph: Column, reached: Column, own: Column) -> Column:
    """depth and at: 1 and the first step on which both parents bear, or 0 where they meet at the end only; depth is null for under two steps or where no step comes from a parent. reached: of reach, own: of owners."""
    marks = lambda x, r, o: F.size(F.array_compact(F.array_distinct(F.transform(F.element_at(r, x["name"]), lambda n: F.element_at(o, n)))))
    meeting = let(F.struct(reached.alias("r"), own.alias("o")), lambda m: F.get(F.filter(graph, lambda x: marks(x, m["r"], m["o"]) >= 2), F.lit(0))["name"])
    measured = (F.size(graph) >= 2) & (F.size(own) > 0)
    return let(meeting, lambda at: F.struct(F.when(measured, F.when(at.isNotNull(), 1).otherwise(0)).alias("depth"), F.when(measured, at).alias("at")))


def crossover_verdict(depth: Column, loose: Column) -> Column:
    """If a crossover may stay: its parents meet before the end, or need not (loose), or no depth was measured."""
    return depth.isNull() | (depth >= 1) | F.coalesce(loose, F.lit(False))


#: Tactics that only close a goal, and tactics that bring a case, a witness or an induction.
CLOSING = ("positivity", "norm_num", "norm_cast", "push_cast", "linarith", "nlinarith", "simp", "simpa", "simp_all", "ring", "ring_nf", "field_simp", "decide", "trivial", "rfl", "omega", "aesop", "assumption", "exact", "linear_combination")
STRUCTURAL = ("rcases", "obtain", "cases", "rintro", "induction", "by_contra", "by_cases", "interval_cases", "constructor", "refine", "use", "calc", "subst", "revert", "specialize", "contrapose", "wlog", "conv", "match")


def closing_lemma(end: Column) -> Column:
    """The lemma of the last `exact Namespace.lemma` at the end of a proof, null without one."""
    found = F.regexp_extract_all(end, F.lit(r"\bexact\s+[A-Za-z_][A-Za-z0-9_']*\.([A-Za-z_][A-Za-z0-9_']*)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def mutation(parent_tactics: Column, child_tactics: Column, parent_lemma: Column, child_lemma: Column, changed: Column) -> Column:
    """kept, why, added, dropped, structural: if a mutation moves its parent's proof, by tactics (arrays of distinct names), closing_lemma of both ends and spine_changed.

    It does not if it ends by its parent's lemma (closing_lemma), rests on its parent's steps only (spine), or keeps all tactics of its parent and adds none but closing ones
    (skeleton). Where either has no tactics there is nothing to compare, and it stays.
    """
    added, dropped = F.array_sort(F.array_except(child_tactics, parent_tactics)), F.array_sort(F.array_except(parent_tactics, child_tactics))
    only_closing = F.size(F.array_except(added, F.array(*map(F.lit, CLOSING)))) == 0
    why = F.when((F.size(parent_tactics) == 0) | (F.size(child_tactics) == 0), None).when(child_lemma == parent_lemma, "closing_lemma").when(~changed, "spine").when((F.size(dropped) == 0) & only_closing, "skeleton")
    return F.struct(why.isNull().alias("kept"), why.alias("why"), added.alias("added"), dropped.alias("dropped"), F.array_intersect(added, F.array(*map(F.lit, STRUCTURAL))).alias("structural"))
