"""Normal forms, fingerprints and parsers of statements and identifiers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: what parts the root ids in a lineage id.
CROSS = "__x__"
#: Letters whose capitals are several letters, or are in no Unicode before 16.
_LIGATURES = [c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1]
_LATE = [*"\u019b\u0264\u1c8a\ua7cd\ua7db", *map(chr, range(0x10D70, 0x10D86))]


def capitals(text: Column) -> Column:
    """text with each letter in its own capital, which is one letter: ß gives ẞ and not SS, and letters without such a capital stay. F.upper writes several letters for them."""
    odd = _LIGATURES + _LATE
    one = {"ß": "ẞ"} | {c: c.title() for c in _LIGATURES if len(c.title()) == 1}
    each = F.regexp_extract_all(text, F.lit(f"[{''.join(odd)}]+|[^{''.join(odd)}]+"), F.lit(0))
    upper = F.transform(each, lambda t: F.when(t.rlike(f"^[{''.join(odd)}]"), F.translate(t, "".join(one), "".join(one.values()))).otherwise(F.upper(t)))
    return F.when(text.rlike(f"[{''.join(odd)}]"), F.array_join(upper, "")).otherwise(F.upper(text))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def compact(text: Column, limit: int) -> Column:
    return F.substring(collapse(text), 1, limit)


def fingerprint(text: Column) -> Column:
    """SHA-256 of the trimmed text; the empty string for text that is empty."""
    text = F.trim(F.coalesce(text, F.lit("")))
    return F.when(text == "", "").otherwise(F.sha2(text, 256))


def plain_digest(text: Column) -> Column:
    """SHA-256 of the text as it is, also if it is empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def strip_comments(code: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(code, r"(?s)/-.*?-/", " "), r"--[^\n]*", " ")


def surface(formal: Column) -> Column:
    """The statement up to its proof, without its name, on one line, in lower case."""
    cut = F.regexp_replace(formal, r"(?s):=\s*by.*$", "")
    return F.lower(collapse(F.regexp_replace(cut, r"\b(theorem|lemma|example)\s+\S+", "$1")))


def alpha_normal(formal: Column) -> Column:
    """The surface with bound names replaced by #0#, #1#, ... in order of binding, so that renamed statements are equal."""
    text = collapse(F.regexp_replace(F.regexp_replace(strip_comments(formal), r"(?s):=\s*by.*$", ""), r"\b(theorem|lemma)\s+\S+", "$1 _"))
    bound = F.regexp_extract_all(text, F.lit(r"[(\[{]\s*((?:[A-Za-z_][\w'₀-₉]*\s+)*[A-Za-z_][\w'₀-₉]*)\s*:|[∀∃λ]\s*\(?\s*((?:[A-Za-z_][\w']*\s+)*[A-Za-z_][\w']*)"), F.lit(0))
    names = F.array_distinct(F.flatten(F.transform(bound, lambda b: F.filter(F.split(F.regexp_replace(b, r"[^\w'₀-₉]+", " "), " "), lambda x: x != ""))))
    numbered = F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("i")))
    rename = lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\w.'])\Q"), p["name"], F.lit(r"\E(?![\w'])")), F.concat(F.lit("#"), p["i"].cast("string"), F.lit("#")))
    return F.aggregate(numbered, text, rename)


def tokens(text: Column, least: int = 3, stop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case identifiers of at least `least` characters, without numbers and stop words, sorted."""
    parts = F.filter(F.split(F.lower(text), r"[^0-9a-zA-Z_]+"), lambda x: (F.length(x) >= least) & ~x.rlike(r"^[0-9]+$"))
    return F.array_sort(F.array_except(F.array_distinct(parts), F.array(*map(F.lit, stop)).cast("array<string>")))


def roots_of(lineage_id: Column) -> Column:
    """Root ids of a lineage id {root[__x__root...]}__{op.op...}__{8 hex}."""
    return F.filter(F.split(F.regexp_replace(lineage_id, r"(__[a-z]+(\.[a-z]+)*__[0-9a-f]{8})+$", ""), CROSS), lambda x: x != "")


def chain_of(lineage_id: Column) -> Column:
    """Operators of the id's last chain."""
    return F.filter(F.split(F.regexp_extract(lineage_id, r"__([a-z]+(?:\.[a-z]+)*)__[0-9a-f]{8}$", 1), r"\."), lambda x: x != "")


def longest_prefix(name: Column, classes: dict[str, str], default: str) -> Column:
    """The class of the longest key that the name begins with."""
    out = F.lit(default)
    for prefix in sorted(classes, key=len):
        out = F.when(F.startswith(name, F.lit(prefix)), classes[prefix]).otherwise(out)
    return out


def last_of(text: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the last match of the first pattern that matches."""
    return F.coalesce(*[F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1)) for p in patterns])


def boxed_answer(text: Column) -> Column:
    """What the last \\boxed{} holds, with nested braces counted; null without one or if it never closes."""
    tail = F.regexp_extract(text, r"(?s).*\\boxed\{(.*)$", 1)
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        depth = F.when(s["depth"] == 0, 0).when(c == "{", s["depth"] + 1).when(c == "}", s["depth"] - 1).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when((s["depth"] > 0) & (depth > 0), F.concat(s["out"], c)).otherwise(s["out"]).alias("out"))

    done = F.aggregate(F.split(tail, ""), start, step)
    return F.when(text.contains("\\boxed{") & (done["depth"] == 0), F.trim(done["out"]))


def near_name(a: Column, b: Column) -> Column:
    """Whether two names are a slip apart: at most 2 edits, and 0.15 of the longer one."""
    d = F.levenshtein(a, b)
    return (d <= 2) & (d <= 0.15 * F.greatest(F.length(a), F.length(b)))


def _thirds(n: Column) -> list[tuple[Column, Column]]:
    """Where three parts of a string of n characters begin, from 0, and their lengths."""
    one, two = F.floor(n / 3).cast("int"), F.floor((n + 1) / 3).cast("int")
    return [(F.lit(0), one), (one, two), (one + two, (n - one - two).cast("int"))]


def part_keys(name: Column) -> Column:
    """A string's three parts with its length and their number. Of two strings two edits apart at most, one has a part that the other has, too, within two places of where it is."""
    n = F.length(name)
    return F.array(*[F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(name, at + 1, size).alias("part")) for i, (at, size) in enumerate(_thirds(n))])


def probe_keys(name: Column) -> Column:
    """All that a string can have of the parts of strings two edits from it: for each length and part, what stands within two places."""

    def around(n: Column, i: int, at: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.greatest(at - 2, F.lit(0)), at + 2), lambda p: F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(name, p + 1, size).alias("part")))

    def of_length(n: Column) -> Column:
        return F.concat(*[around(n, i, at, size) for i, (at, size) in enumerate(_thirds(n))])

    lengths = F.sequence(F.greatest(F.length(name) - 2, F.lit(0)), F.length(name) + 2)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))
