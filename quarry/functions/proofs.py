"""Parts, shapes and outcomes of formal statements and their proofs, as Column functions. Null text is empty."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions.spine import let
from quarry.functions.text import strip_comments

#: Tests of a goal, first one that holds; a goal that meets none is `other`.
SHAPES = (("divisibility", r"∣|gcd|lcm|Prime|%"), ("inequality", r"[<>]|≤|≥"), ("iff", "↔"), ("existential", "∃"), ("universal", "∀"), ("equation", "="))

#: Fixed value: a hypothesis that bounds a variable by a number of two digits or more.
LITERAL_BOUND = r"[({]\s*[^:(){}]*:\s*[^(){}]*?\b[a-zA-Z_][a-zA-Z0-9_']*\s*(?:≤|<|≥|>)\s*(\d{2,})\s*[)}]"

#: Fixed value: a hypothesis or binder of one name.
HYPOTHESIS = r"\([A-Za-z_][A-Za-z0-9_₀-₉']*\s*:"

#: What a failure's summary says, by kind, first kind first; a summary that says none is `other`.
ERRORS = (
    ("unknown_identifier", ("unknown identifier", "unknown constant")),
    ("signature_drift", ("invalid field", "type mismatch")),
    ("unsolved_goals", ("unsolved goals",)),
    ("resource_limit", ("timeout", "maxheartbeats", "deterministic")),
    ("contains_sorry", ("sorry",)),
)

#: How a turn's system error begins, by outcome.
TURN_ERRORS = (("model_timeout", "model_timeout:"), ("model_error", "model_exception:"), ("extraction_error", "model returned no fenced lean code"), ("policy_rejection", "model used forbidden"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _strip(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"^\s+|\s+$", "")


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"\s+$", "")


def _cases(pairs: list[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for condition, label in reversed(pairs):
        out = F.when(condition, label).otherwise(out)
    return out


def goal_of(statement: Column) -> Column:
    """What follows the first colon outside all brackets; the whole statement without one."""
    body = _rstrip(F.regexp_replace(_strip(statement), r":=\s*by\s*$", ""))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("depth"), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        here = (s["at"] == 0) & (s["depth"] == 0) & (c == ":")
        turn = F.when(c.isin(*"([{⟨"), 1).when(c.isin(*")]}⟩"), -1).otherwise(0)
        return F.struct((s["end"] + F.length(c)).alias("end"), (s["depth"] + turn).alias("depth"), F.when(here, s["end"] + 1).otherwise(s["at"]).alias("at"))

    pieces = lambda text: F.regexp_extract_all(text, F.lit(r":=|[:(\[{⟨)\]}⟩]|[^:(\[{⟨)\]}⟩]+"), F.lit(0))
    after = lambda text: F.aggregate(pieces(text), start, step, lambda s: F.when(s["at"] > 0, _strip(F.substr(text, s["at"] + 1))).otherwise(text))
    return let(body, after)


def goal_shape(statement: Column) -> Column:
    return let(goal_of(statement), lambda goal: _cases([(goal.rlike(pattern), label) for label, pattern in SHAPES], "other"))


def hypothesis_bucket(statement: Column) -> Column:
    """closed without a hypothesis, light with one or two, else rich."""
    n = F.regexp_count(_text(statement), F.lit(HYPOTHESIS))
    return F.when(n == 0, "closed").when(n <= 2, "light").otherwise("rich")


def literal_bounds(statement: Column) -> Column:
    """Sorted distinct numbers by which hypotheses bound a variable; those beyond 64 bits are left out."""
    head = F.substring_index(strip_comments(_text(statement)), ":= by", 1)
    found = F.regexp_extract_all(head, F.lit(LITERAL_BOUND), F.lit(1))
    return F.array_sort(F.array_compact(F.array_distinct(F.transform(found, lambda x: x.try_cast("long")))))


def introduced_bounds(parent: Column, child: Column) -> Column:
    """Bounds of a child that its parent lacks."""
    return F.array_except(literal_bounds(child), literal_bounds(parent))


def theorem_prefix(source: Column) -> Column:
    """A declaration up to and with its `:= by`; one whose proof is a term gets ` by` after its `:=`."""
    text = _strip(source)
    by, assign = (F.regexp_extract(text, rf"(?s)^(.*?{end})", 1) for end in (r":=\s*by\b", ":="))
    return F.when(by != "", by).when(assign != "", F.concat(assign, F.lit(" by"))).otherwise(text)


def header_of(source: Column) -> Column:
    """What precedes the first declaration; empty without one."""
    text = _strip(source)
    at = F.regexp_instr(text, F.lit(r"(?m)^[ \t]*(?:theorem|lemma|example)\b"))
    return F.when(at > 0, _rstrip(F.substring(text, F.lit(1), at - 1))).otherwise("")


def strict_header(header: Column) -> Column:
    """The header with implicit variables turned off, once."""
    text, strict = _strip(header), F.lit("set_option autoImplicit false")
    return F.when(text.rlike(r"(?m)^[ \t]*set_option[ \t]+autoImplicit[ \t]+false\b"), text).when(text == "", strict).otherwise(F.concat_ws("\n", text, strict))


def assemble(header: Column, statement: Column, body: Column) -> Column:
    """One file of header, statement and proof; empty without a statement."""
    claim, proof = _strip(statement), _rstrip(body)
    open_ended = F.when(claim.rlike(r":=\s*by\s*$"), claim).otherwise(F.concat(F.regexp_replace(claim, r"\s*:=\s*$", ""), F.lit(" := by")))
    indented = F.when((proof == "") | proof.rlike(r"^[\n ]"), proof).otherwise(F.concat(F.lit("\n  "), proof))
    return F.when(claim == "", "").otherwise(F.concat(_rstrip(header), F.lit("\n\n"), open_ended, indented, F.lit("\n")))


def has_sorry(code: Column) -> Column:
    return strip_comments(_text(code)).rlike(r"\bsorry\b")


def proof_metrics(body: Column, vocabulary: tuple[str, ...]) -> Column:
    """Struct of n_steps (lines of code), tactics (distinct first words of lines that the vocabulary has, in order), uses_induction, uses_cases and n_chars."""
    code = F.regexp_replace(F.regexp_replace(_text(body), r"--[^\n]*", ""), r"(?s)/-.*?-/", "")
    lines = F.filter(F.transform(F.split(code, r"\n"), _strip), lambda x: x != "")
    heads = F.transform(lines, lambda x: F.substring_index(F.regexp_replace(x, "^[·<;>| ]+", ""), " ", 1))
    return F.struct(
        F.size(lines).alias("n_steps"), F.array_distinct(F.filter(heads, lambda x: x.isin(*vocabulary))).alias("tactics"),
        code.rlike(r"\binduction\b").alias("uses_induction"), code.rlike(r"\b(cases|rcases|obtain|constructor)\b").alias("uses_cases"), F.length(code).alias("n_chars"),
    )


def unescape(text: Column) -> Column:
    """Doubled backslashes before letters, brackets and points made single, then four-digit escapes made characters (a half of a pair becomes U+FFFD)."""
    single = F.regexp_replace(_text(text), r"\\\\(?=[A-Za-z{}()\[\]!,;:.\-])", r"\\")
    codes = F.array_distinct(F.regexp_extract_all(single, F.lit(r"\\u([0-9a-fA-F]{4})"), F.lit(1)))
    return F.aggregate(codes, single, lambda t, c: F.replace(t, F.concat(F.lit("\\u"), c), F.decode(F.unhex(c), "UTF-16BE")))


def error_kind(summary: Column) -> Column:
    said = F.lower(_text(summary))
    return _cases([(said.contains(mark), kind) for kind, marks in ERRORS for mark in marks], "other")


def turn_outcome(complete: Column, ok: Column, system_error: Column, code: Column) -> Column:
    """The outcome of a prover's turn: proved, a fault of the model or the system, or what is wrong with the proof."""
    error, fine = _text(system_error), F.coalesce(ok, F.lit(False))
    begun = [(F.startswith(error, F.lit(head)), label) for label, head in TURN_ERRORS]
    return _cases([(F.coalesce(complete, F.lit(False)), "valid_no_sorry"), *begun, (error != "", "verifier_system_error"), (fine & has_sorry(code), "valid_with_sorry"), (fine, "valid_but_incomplete")], "lean_error")


def episode_outcome(r: Column, max_actions: int) -> Column:
    """Why an episode ended, from a struct of success, statement_invalid, verifier_failed, generator_empty (booleans), n_attempts (null for a
    search of tactics), tokens_used, token_budget, sampled_batches, actions and n_steps. Null flags are false, null counts 0.

    What was never measured comes before a spent budget, and an empty reply counts as such only where the episode has nothing else.
    """
    flag = lambda name: F.coalesce(r[name], F.lit(False))
    count = lambda name: F.coalesce(r[name], F.lit(0))
    whole = r["n_attempts"].isNotNull()
    return _cases([
        (flag("success"), "solved"), (flag("statement_invalid"), "statement_invalid"), (flag("verifier_failed"), "verifier_error"),
        (flag("generator_empty") & (count("n_attempts") == 0) & (count("tokens_used") == 0), "generator_empty"),
        ((count("token_budget") > 0) & (count("tokens_used") >= count("token_budget")), "token_budget"),
        (whole & (count("n_attempts") == 0), "generator_empty"), (whole, "attempts_exhausted"), (count("sampled_batches") == 0, "sampler_empty"),
        (count("actions") >= max_actions, "action_budget"), (count("n_steps") == 0, "no_accepted_step"),
    ], "search_exhausted")


def relation(forward: Column, backward: Column) -> Column:
    """How a child stands to its parent, whose implication was tried forward (to the child) and backward."""
    f, b = F.coalesce(forward, F.lit(False)), F.coalesce(backward, F.lit(False))
    return _cases([(f & b, "restatement"), (b, "child_stronger"), (f, "child_weaker")], "undetermined")
