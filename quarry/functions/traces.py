"""Records of attempts: what was complained about, traces of bounded size, texts for retrieval, proofs of seeds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters of a trace's code and of a card's prose.
CODE, PROSE = 20_000, 400


def _said(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def messages(*lists: Column) -> Column:
    """The messages of all lists (arrays of structs with `message`), in their order, without empty ones; a null list has none."""
    each = [F.transform(F.coalesce(x, F.filter(x, lambda _: F.lit(False)), F.array()), lambda m: m["message"]) for x in lists]
    return F.filter(F.flatten(F.array_compact(F.array(*each))), lambda m: m.isNotNull() & (m != ""))


def unknown_names(found: Column) -> Column:
    """Sorted distinct names that messages call unknown."""
    names = F.flatten(F.transform(found, lambda m: F.regexp_extract_all(m, F.lit(r"[Uu]nknown (?:identifier|constant) [`']([^`']+)[`']"), F.lit(1))))
    return F.array_sort(F.array_distinct(names))


def trace(code: Column, most: int = CODE) -> Column:
    """code and if it was cut: the code of an attempt up to so many characters."""
    whole = F.coalesce(code, F.lit(""))
    return F.struct(F.substring(whole, 1, most).alias("code"), (F.length(whole) > most).alias("cut"))


def card_text(lesson: Column, goal: Column, signature: Column, flags: Column, formal: Column, most: int = PROSE) -> Column:
    """What a card is about, in one text: its lesson, goal, signature and flags, and the beginning of its statement without ids of problems; blank parts are left out."""
    statement = F.substring(F.regexp_replace(F.coalesce(formal, F.lit("")), r"\b\w+__\w+", ""), 1, most)
    parts = F.array(F.coalesce(lesson, F.lit("")), F.coalesce(goal, F.lit("")), F.coalesce(signature, F.lit("")), F.array_join(F.coalesce(flags, F.array().cast("array<string>")), " "), statement)
    return F.array_join(F.filter(parts, lambda p: _said(p) != ""), " ")


def proof_of(header: Column, *columns: Column) -> Column:
    """The first of the columns that is not blank, without the header that it may begin with; empty without one."""
    found = F.coalesce(*[F.nullif(_said(c), F.lit("")) for c in columns], F.lit(""))
    head = _said(header)
    return F.when((head != "") & F.startswith(found, head), _said(F.substring(found, F.length(head) + 1, F.length(found)))).otherwise(found)


def bare_statement(text: Column) -> Column:
    """A statement up to its proof without comments and white space, so that two ways to set it are equal."""
    code = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"--[^\n]*", ""), r"(?s)/-.*?-/", "")
    return F.regexp_replace(F.substring_index(code, ":=", 1), r"\s+", "")
