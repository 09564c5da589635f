"""Release records: a row with all that is known of it, what each check decided and who decided it, and whether it is admitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.operators.release import admitted_by_both, overlay

#: Checks of a release record and what decides them.
CHECKS = (("statement_type_check", "lean"), ("proof_accepted", "lean"), ("axiom_audit", "lean"), ("vacuity", "lean"), ("dead_hypotheses", "lean"), ("corpus_dedup", "hash"), ("redundancy", "lean"), ("hypothesis_preservation", "parser"), ("comparator", "lean"), ("goal_roundtrip", "model"))
#: Why a judged row is not admitted.
WHY = {
    "mismatch": "prose does not describe the elaborated goal", "undecided": "goal round-trip never returned a verdict", "excluded": "held back by hand: a binder that can be substituted away",
    "redundant": "Lean proved it without a hypothesis it states", "weak": "not strong in both passes", "dropped": "not kept in both passes",
}
NOT_RUN = "not run"


def assembled(rows: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """rows (key, statement, formal, code, ...) with evidence laid over them; a table that is missing has no effect.

    prune (formal, code, removed) replaces both texts, dead (silent) tells of hypotheses that are used without being named, comparator (prepared) and replays (replayed) are of one
    kind, roundtrip (equivalent, mismatches, rationale), redundancy (measured, free, universal, why), rewrites (accepted, after) replace the statement if they were accepted,
    exclusions (why) hold a row back. Each table has a row to a key.
    """
    names = {
        "prune": ("pruned_formal", "pruned_code", "removed"), "dead": ("silent",), "comparator": ("prepared",), "replays": ("replayed",), "roundtrip": ("equivalent", "mismatches", "rationale"),
        "redundancy": ("measured", "free", "universal", "redundant_why"), "rewrites": ("accepted", "after"), "exclusions": ("excluded_why",),
    }
    known = {n: t.toDF(key, *names[n]) for n, t in tables.items()}
    out = overlay(rows, key, known)
    for name, columns in names.items():
        if name not in tables:
            out = out.withColumns({f"has_{name}": F.lit(False), **{c: F.lit(None).cast({"removed": "array<string>", "silent": "array<string>", "mismatches": "array<string>", "free": "array<string>", "universal": "array<string>", "prepared": "boolean", "replayed": "boolean", "equivalent": "boolean", "measured": "boolean", "accepted": "boolean"}.get(c, "string")) for c in columns}})
    rewritten = F.coalesce(F.col("accepted") & (F.col("after") != ""), F.lit(False))
    texts = {"formal": F.coalesce("pruned_formal", "formal"), "code": F.coalesce("pruned_code", "code"), "before": F.when(rewritten, F.col("statement")), "statement": F.when(rewritten, F.col("after")).otherwise(F.col("statement"))}
    return out.withColumns({f"__{n}": c for n, c in texts.items()}).withColumns({n: F.col(f"__{n}") for n in texts}).drop(*[f"__{n}" for n in texts])


def _has(items: str) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def is_redundant() -> Column:
    return F.coalesce(F.col("measured"), F.lit(False)) & (_has("free") | _has("universal"))


def checks() -> Column:
    """map of each check to (by, applies, ran, result). Reads what assembled gives and certificate (struct of statement, proof, audited, allowed, axioms), vacuity, corpus, duplicate_of, preserved, variant."""
    text = lambda c: F.coalesce(c, F.lit("")).cast("string")
    true = lambda c: F.coalesce(c, F.lit(False))
    listed = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    cert, silent = F.col("certificate"), F.coalesce(F.col("variant") == "mutation_silent", F.lit(False))
    found = {
        "statement_type_check": (true(cert["statement"]), F.lit("type-checks")),
        "proof_accepted": (true(cert["proof"]), F.lit("accepted, no sorry")),
        "axiom_audit": (true(cert["audited"]), F.concat(F.when(true(cert["allowed"]), "closed over ").otherwise("disallowed: "), listed(cert["axioms"]))),
        "vacuity": (F.col("vacuous").isNotNull(), F.when(F.col("vacuous"), "VACUOUS").otherwise("hypotheses are satisfiable")),
        "dead_hypotheses": (F.col("has_prune") | F.col("has_dead"), F.when(_has("removed"), F.concat(F.lit("removed "), listed(F.col("removed")))).otherwise("every hypothesis is load-bearing")),
        "corpus_dedup": (F.col("corpus").isNotNull(), F.when(F.col("duplicate_of").isNull(), F.concat(F.lit("unique against "), text(F.col("corpus")), F.lit(" statements"))).otherwise(F.concat(F.lit("duplicate of "), text(F.col("duplicate_of"))))),
        "redundancy": (true(F.col("measured")), F.coalesce(F.nullif("redundant_why", F.lit("")), F.when(_has("free"), F.concat(F.lit("hypotheses Lean could drop: "), listed(F.col("free")))), F.lit("no hypothesis Lean could drop, no parent it could prove alone"))),
        "hypothesis_preservation": (F.col("preserved").isNotNull(), F.when(F.col("preserved"), "every hypothesis the parent had is still there").otherwise("changed")),
        "comparator": (true(F.col("replayed")), F.lit("statement, axioms and kernel acceptance independently replayed")),
        "goal_roundtrip": (F.col("equivalent").isNotNull(), F.when(F.col("equivalent"), "elaborated goal reads back as the stated problem").otherwise(F.concat(F.lit("MISMATCH: "), F.coalesce(F.array_join("mismatches", "; "), F.lit(""))))),
    }
    pending = {"comparator": F.when(true(F.col("prepared")), "workspace prepared and ready; kernel replay still pending"), "goal_roundtrip": F.when(F.col("has_roundtrip"), "check did not complete")}
    applies = {"redundancy": ~silent, "hypothesis_preservation": silent}
    cell = lambda n, by: F.struct(F.lit(by).alias("by"), applies.get(n, F.lit(True)).alias("applies"), found[n][0].alias("ran"), F.when(found[n][0], found[n][1]).otherwise(F.coalesce(pending.get(n, F.lit(None)), F.lit(NOT_RUN))).alias("result"))
    return F.create_map(*[x for n, by in CHECKS for x in (F.lit(n), cell(n, by))])


def admission() -> Column:
    """admitted, why, detail of a row that both passes judged (strong1, keep1, strong2, keep2): the first reason that holds."""
    reasons = (
        ("mismatch", F.col("has_roundtrip") & ~F.col("equivalent"), F.substring("rationale", 1, 300)), ("undecided", F.col("has_roundtrip") & F.col("equivalent").isNull(), F.substring("rationale", 1, 300)),
        ("excluded", F.col("has_exclusions"), F.substring("excluded_why", 1, 400)), ("redundant", is_redundant(), F.concat_ws("; ", F.array_join("free", ", "), F.array_join("universal", ", "))),
        ("weak", ~F.coalesce(F.col("strong1") & F.col("strong2"), F.lit(False)), F.lit("")), ("dropped", ~F.coalesce(admitted_by_both(), F.lit(False)), F.lit("")),
    )
    why, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, holds, said in reversed(reasons):
        holds = F.coalesce(holds, F.lit(False))
        why, detail = F.when(holds, WHY[name]).otherwise(why), F.when(holds, F.coalesce(said, F.lit(""))).otherwise(detail)
    return F.struct(why.isNull().alias("admitted"), why.alias("why"), detail.alias("detail"))


def level(audits: DataFrame, replays: DataFrame, key: str, blanket: Column) -> DataFrame:
    """key, level of rows (key, statement, proof, audited, allowed) with replays (key, platform, digest, passed): statement_checked, proof_accepted, axiom_audited or kernel_replayed, null for none of them.

    Each step needs the one before. The last needs passed replays on two different platforms with one digest; blanket stands for a passed audit where a row has none.
    """
    replayed = replays.where("passed").groupBy(key).agg(F.count_distinct("platform").alias("platforms"), F.count_distinct("digest").alias("digests"))
    rows = audits.join(replayed, key, "left")
    true = lambda c: F.coalesce(c, F.lit(False))
    audited = F.when(true(F.col("audited")), true(F.col("allowed"))).otherwise(true(blanket))
    proof = true(F.col("statement")) & true(F.col("proof"))
    found = F.when(proof & audited & (F.col("platforms") >= 2) & (F.col("digests") == 1), "kernel_replayed").when(proof & audited, "axiom_audited").when(proof, "proof_accepted").when(true(F.col("statement")), "statement_checked")
    return rows.select(key, found.alias("level"))
