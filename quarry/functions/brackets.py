"""Statements taken apart by counting brackets, at any depth and in one pass over their characters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

from quarry.functions.parse import without_comments
from quarry.functions.spine import let

#: Types whose binders bring a value and no assumption, by the word that they begin with.
NUMBERS = ("ℕ", "ℤ", "ℝ", "ℚ", "ℂ", "Nat", "Int", "Real", "Rat", "Complex", "Bool", "Char", "String")
CONTAINERS = ("Type", "Sort", "Prop", "Set", "Finset", "Multiset", "List", "Fin", "Vector", "Matrix", "Polynomial", "Subgroup", "Submodule", "Ideal", "Filter")
DATA = rf"^(?:(?:{'|'.join(NUMBERS)})(?![\w.])|(?:{'|'.join(CONTAINERS)})\b|[A-Za-z_][A-Za-z0-9_']*\s*→|[A-Za-zΑ-Ωα-ω_][A-Za-z0-9Α-Ωα-ω_']*\s*\*?$)"
#: What a type has that makes its binder a hypothesis in comparisons of a parent and a child.
RELATIONS = ("=", "≤", "<", "≥", ">", "≠", "∣", "∈", "⊆", "∧", "∨", "→", "¬", "≡", "Prime", "Odd", "Even", "Nonempty", "Fintype.card")
#: What makes a binder's type a proposition.
PROPOSITION = "[=<>≤≥≠∣∧∨¬→↔∀∃]"
PARTS = "binders array<struct<names:array<string>,type:string,open:string,start:int,end:int>>, head string, goal string"

_OPEN, _CLOSES = "([{⟨", dict(zip("([{⟨", ")]}⟩", strict=True))
_BRACKET, _MARK = re.compile(r"[(\[{⟨)\]}⟩]"), re.compile(r"[(\[{⟨]|:=?")
_BINDER = pa.struct([("names", pa.list_(pa.string())), ("type", pa.string()), ("open", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_PARTS = pa.struct([("binders", pa.list_(_BINDER)), ("head", pa.string()), ("goal", pa.string())])
_NAME = re.compile(r"(?:[^\W\d]|_)[\w'!?₀-₉⁰-ⁿ]*|#\d+#")
_TITLE = re.compile(r"\s*(?:theorem|lemma|example)(?:\s+[^\s({\[:]\S*)?")


def _pairs(text: str) -> dict[int, int]:
    """The place of its closing bracket for each opening one that has one."""
    stack, found = [], {}
    for m in _BRACKET.finditer(text):
        i, c = m.start(), m.group()
        if c in _OPEN:
            stack.append(i)
        elif stack and _CLOSES[text[stack[-1]]] == c:
            found[stack.pop()] = i
    return found


def _parts(statement: str | None) -> tuple[list[tuple], str, str]:
    text = statement or ""
    title = _TITLE.match(text)
    begin = title.end() if title else 0
    pairs, binders = _pairs(text), []
    at, colon, end = begin, None, len(text)
    while m := _MARK.search(text, at):
        at, mark = m.start(), m.group()
        if at in pairs:
            close = pairs[at]
            if colon is None and mark in "({[":
                names, sep, kind = text[at + 1 : close].partition(":")
                names = names.split()
                if sep and names and not kind.startswith("=") and all(map(_NAME.fullmatch, names)):
                    binders.append((names, " ".join(_outside(kind)[0].split()), mark, at, close + 1))
            at = close
        elif mark == ":=":
            end = at
            break
        elif mark == ":" and colon is None:
            colon = at
        at += 1
    head_end = end if colon is None else colon
    return binders, " ".join(text[begin:head_end].split()), "" if colon is None else text[colon + 1 : end].strip()


def _outside(kind: str) -> tuple[str, str, str]:
    """A type before, and its default value after, a `:=` that is in no bracket."""
    if ":=" not in kind:
        return kind, "", ""
    pairs, at = _pairs(kind), 0
    while m := _MARK.search(kind, at):
        at = m.start()
        if m.group() == ":=":
            return kind[:at], ":=", kind[at + 2 :]
        at = pairs.get(at, at) + 1
    return kind, "", ""


def parts(statement: Column | str) -> Column:
    """binders (with their places in code points, ends exclusive), head (all before the goal) and goal of a statement. A default value is no part of a binder's type; null is the empty statement."""

    @F.arrow_udf(PARTS)
    def run(statements: pa.Array) -> pa.Array:
        return pa.array(map(_parts, statements.to_pylist()), _PARTS)

    return run(statement)


def is_data(kind: Column) -> Column:
    return (kind == "") | kind.rlike(DATA)


def assumptions(binders: Column) -> Column:
    """Names of round binders that assume something: their type does not begin like one of data."""
    return F.flatten(F.transform(F.filter(binders, lambda b: (b["open"] == "(") & (F.size(b["names"]) == 1) & ~is_data(b["type"])), lambda b: b["names"]))


def unconditional(found: Column) -> Column:
    """A statement (parts) that assumes nothing: no such binder, and no arrow in the goal outside of brackets."""
    flat = lambda t: F.regexp_replace(t, r"[(\[{⟨][^()\[\]{}⟨⟩]*[)\]}⟩]", "")
    depth = F.greatest(F.size(F.regexp_extract_all(found["goal"], F.lit(r"[(\[{⟨]"), F.lit(0))), F.lit(1))
    outer = F.aggregate(F.sequence(F.lit(1), depth), found["goal"], lambda t, _: flat(t))
    return (F.size(assumptions(found["binders"])) == 0) & (found["goal"] != "") & ~outer.contains("→")


def _cut(statement: Column, gone: Column) -> Column:
    """The statement without these binders."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda s, b: F.struct(b["end"].alias("at"), F.concat(s["out"], F.substring(statement, s["at"] + 1, b["start"] - s["at"])).alias("out"))
    return F.aggregate(gone, begin, cut, lambda s: F.concat(s["out"], F.substring(statement, s["at"] + 1, F.length(statement))))


def without(statement: Column, found: Column, names: Column) -> Column:
    """The statement as a probe without the binders of these names (array)."""
    rest = _cut(statement, let(names, lambda gone: F.filter(found["binders"], lambda b: F.arrays_overlap(b["names"], gone))))
    title = F.regexp_replace(rest, r"^\s*(?:theorem|lemma|example)(?:\s+[^\s({\[:]\S*)?", "")
    return F.concat(F.lit("theorem _probe "), F.trim(F.regexp_replace(F.regexp_replace(title, r"(?s):=\s*(by)?\s*$", ""), r"\s+", " ")))


def propositions(found: Column) -> Column:
    """array of (names, type) of binders whose type is a proposition, without brackets around the whole type."""
    some = F.filter(found["binders"], lambda b: b["type"].rlike(PROPOSITION))
    return F.transform(some, lambda b: F.struct(b["names"].alias("names"), F.regexp_replace(b["type"], r"^\(([^()]*)\)$", "$1").alias("type")))


def unmentioned(statement: Column, found: Column, code: Column) -> Column:
    """Names of hypotheses that the rest of the statement and the proof never mention: they may be idle."""
    rest = F.substring_index(_cut(statement, found["binders"]), ":=", 1)
    words = F.regexp_extract_all(F.concat_ws(" ", rest, without_comments(code)), F.lit(r"[A-Za-z_][A-Za-z0-9_']*"), F.lit(0))
    return F.array_except(F.flatten(F.transform(propositions(found), lambda b: b["names"])), words)


def normal_type(kind: Column) -> Column:
    """A type without brackets around single names or numbers, at any depth, and without white space."""
    once = lambda t: F.regexp_replace(t, r"\((\s*(?:[A-Za-z_][A-Za-z0-9_'!?₀-₉]*|#\d+#|\d+)\s*)\)", "$1")
    depth = F.greatest(F.size(F.regexp_extract_all(kind, F.lit(r"\("), F.lit(0))), F.lit(1))
    return F.regexp_replace(F.aggregate(F.sequence(F.lit(1), depth), kind, lambda t, _: once(t)), r"\s+", "")


def hypotheses(found: Column) -> Column:
    """array of (name, type): each name of a binder whose type has one of RELATIONS, with the normal type; a name that is bound again counts with its last type."""
    some = F.filter(found["binders"], lambda b: b["type"].rlike("|".join(map(re.escape, RELATIONS))) & b["open"].isin("(", "{"))
    each = F.flatten(F.transform(some, lambda b: F.transform(b["names"], lambda n: F.struct(n.alias("name"), normal_type(b["type"]).alias("type")))))
    return let(each, lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda y: y["name"] == x["name"])))


def changed(parent: Column, child: Column) -> Column:
    """dropped and added hypotheses (`name : type`) of a child against its parent, by type; repeated ones each count."""
    said = lambda a, b: F.transform(F.filter(a, lambda x: ~F.exists(b, lambda y: y["type"] == x["type"])), lambda x: F.concat_ws(" : ", x["name"], x["type"]))
    both = F.struct(parent.alias("parent"), child.alias("child"))
    return let(both, lambda x: F.struct(said(x["parent"], x["child"]).alias("dropped"), said(x["child"], x["parent"]).alias("added")))
