"""Parts of statements, proofs, model replies and diagnostics, as Columns. Null text is empty."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

#: Tactics that are known by their first word.
TACTICS = ("simp", "omega", "norm_num", "linarith", "nlinarith", "ring", "exact", "rw", "intro", "apply", "decide", "native_decide", "cases", "induction", "use", "constructor")
#: Axioms that a proof may use.
ALLOWED_AXIOMS = ("propext", "Classical.choice", "Quot.sound")
#: Families of exercises, the first pattern that is found counts.
FAMILIES = (
    ("gcd_divisor_sum", r"sum of (the )?divisors.*(gcd|greatest common)"), ("gcd", r"greatest common|\bgcd\b"), ("units_digit", r"units? digit"), ("divisor_sum_mod", r"remainder.*divisors"), ("divisor_sum", r"divisors"),
    ("stars_and_bars", r"nonnegative integer solutions"), ("arithmetic_series", r"arithmetic (series|sequence|progression)"), ("modular_congruence", r"remainder|\bmod(ulo)?\b"),
)
#: What a diagnostic says when a premise has to be looked for.
LOOK_UP = r"unknown (identifier|constant)|unsolved goals|failed to synthesize|type mismatch|no goals|linarith failed|simp made no progress|invalid field"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(group))


def without_comments(code: Column) -> Column:
    """Code without block and line comments."""
    return F.regexp_replace(F.regexp_replace(_text(code), r"(?s)/-.*?-/", ""), r"--[^\n]*", "")


def tactics(code: Column) -> Column:
    """Known tactics that begin a line of a proof, in order, once each."""
    heads = F.transform(F.split(without_comments(code), r"\n|;|<;>"), lambda line: F.regexp_extract(line, r"^[\s·]*(?:by\s+)?([a-z_]+)", 1))
    return F.array_distinct(F.filter(heads, lambda h: h.isin(*TACTICS)))


def is_stub(code: Column) -> Column:
    """No proof, or none but a placeholder or a triviality."""
    bare = F.trim(F.regexp_replace(without_comments(code), r"\s+", " "))
    return (bare == "") | bare.rlike(r"^(:= )?(by )?(sorry|admit|trivial|rfl)$") | bare.rlike(r": True\b")


def proof_nodes(code: Column) -> Column:
    """array of (name, uses): the steps that `have` introduces, and which steps before or after each one's text names."""
    blocks = F.slice(F.split(without_comments(code), r"\bhave\s+"), 2, 1_000_000)
    names = F.transform(blocks, lambda b: F.regexp_extract(b, r"^([A-Za-z_][A-Za-z0-9_']*)", 1))
    return F.zip_with(names, blocks, lambda n, b: F.struct(n.alias("name"), F.array_remove(F.array_intersect(all_of(b, r"[A-Za-z_][A-Za-z0-9_']*"), names), n).alias("uses")))


def axiom_audit(closure: Column) -> tuple[Column, Column]:
    """Whether an audit was run, and whether it passed, null where it was not: no axiom outside of those allowed."""
    return closure.isNotNull(), F.size(F.array_except(closure, F.array(*map(F.lit, ALLOWED_AXIOMS)))) == 0


def answer(text: Column, strategy: Column) -> Column:
    """The answer in a solution by strategy: boxed, hash (after ####) or last_number; what a strategy does not find, the last number gives."""
    last = lambda p, g: F.element_at(all_of(text, p, g), -1)
    number = F.when(F.size(all_of(text, r"-?\d+")) > 0, last(r"-?\d+", 0))
    found = F.when(strategy == "boxed", F.when(F.size(all_of(text, r"boxed\{([^{}]*)\}", 1)) > 0, last(r"boxed\{([^{}]*)\}", 1))).when(strategy == "hash", F.nullif(F.regexp_extract(_text(text), r"####\s*(\S+)", 1), F.lit("")))
    return F.coalesce(found, number)


def family(statement: Column) -> Column:
    low = F.lower(_text(statement))
    return F.coalesce(*[F.when(low.rlike(p), name) for name, p in FAMILIES])


def verdict(reply: Column) -> Column:
    """decision, level and reason of a judge's reply: the first JSON object in it; what is missing is keep, acceptable and empty, and a reason is cut at 400 characters."""
    x = F.from_json(F.regexp_extract(_text(reply), r"(?s)(\{[^{}]*\})", 1), "decision string, level string, reason string")
    return F.struct(F.coalesce(x["decision"], F.lit("keep")).alias("decision"), F.coalesce(x["level"], F.lit("acceptable")).alias("level"), F.substring(F.coalesce(x["reason"], F.lit("")), 1, 400).alias("reason"))


def code_block(reply: Column) -> Column:
    """The last fenced block of a reply; the whole reply without one."""
    found = all_of(reply, r"```[a-z0-9]*\n([^`]*)```", 1)
    return F.when(F.size(found) > 0, F.trim(F.regexp_replace(F.element_at(found, -1), r"\n+$", ""))).otherwise(F.trim(_text(reply)))


def messages(log: Column) -> Column:
    """array of (line, column, severity, body) of diagnostics `file:line:column: severity: body`; lines that begin none belong to the body before."""
    marked = F.split(F.regexp_replace(_text(log), r"(?m)^[^\s:]+:(\d+):(\d+): (error|warning|info): ", "\u0001$1\u0002$2\u0002$3\u0002"), "\u0001")
    parts = F.transform(F.slice(marked, 2, 1_000_000), lambda m: F.split(m, "\u0002", 4))
    return F.transform(parts, lambda p: F.struct(p[0].cast("int").alias("line"), p[1].cast("int").alias("column"), p[2].alias("severity"), F.trim(F.regexp_replace(p[3], r"\n+$", "")).alias("body")))


def state_of(found: Column) -> Column:
    """solved, active (errors that only say that goals are left) or rejected, by the messages of a step."""
    errors = F.filter(found, lambda m: m["severity"] == "error")
    return F.when(F.size(errors) == 0, "solved").when(F.forall(errors, lambda m: m["body"].startswith("unsolved goals")), "active").otherwise("rejected")


def wants_retrieval(log: Column) -> Column:
    return F.lower(_text(log)).rlike(LOOK_UP)


def premises(code: Column) -> Column:
    """Dotted or capitalised names that a proof may take from a library, sorted."""
    return F.array_sort(F.array_distinct(all_of(without_comments(code), r"\b[A-Z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_']+)+")))


def declarations(code: Column) -> Column:
    """array of (name, text) of a file's declarations; each goes as far as the next one begins."""
    blocks = F.split(F.regexp_replace(_text(code), r"(?m)^(theorem|lemma|def|abbrev)\s", "\u0001$1 "), "\u0001")
    return F.transform(F.slice(blocks, 2, 1_000_000), lambda b: F.struct(F.regexp_extract(b, r"^\w+ ([A-Za-z0-9_.']+)", 1).alias("name"), F.trim(F.regexp_replace(b, r"\n\n+", "\n")).alias("text")))


def hints(code: Column) -> Column:
    """Three levels of hints for a proof: the tactics in it, its first line that is no bookkeeping, and all of it but its last line; levels that say nothing are left out."""
    lines = F.filter(F.transform(F.split(without_comments(code), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(by|intro|intros|constructor)\b"))
    level = lambda n, text: F.when(F.coalesce(text, F.lit("")) != "", F.struct(F.lit(n).alias("level"), text.alias("hint")))
    return F.array_compact(F.array(level(1, F.array_join(tactics(code), ", ")), level(2, F.get(lines, F.lit(0))), level(3, F.array_join(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))))


def violation(parent: Column, child: Column, projected: list[str]) -> Column:
    """The first breach of a contract between a parent and a child (family, params map, operator, evidence map of parent ids), null if there is none."""
    missing = F.size(F.filter(F.map_keys(parent["params"]), lambda k: child["params"][k].isNull()))
    changed = [child["params"][p] != parent["params"][p] for p in projected]
    unsaid = ~F.forall(child["parents"], lambda p: F.coalesce(child["evidence"][p], F.lit("")) != "")
    return F.coalesce(F.when(parent["family"] != child["family"], "family"), F.when(missing > 0, "missing_param"), F.when(F.coalesce(reduce(or_, changed), F.lit(False)), "changed_param"), F.when((child["operator"] == "crossover") & unsaid, "no_evidence"))
