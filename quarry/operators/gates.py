"""Admission with a recorded reason, the certificate ladder and budget parity. Booleans have three values: null is not measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Levels of a certificate, lowest first.
LEVELS = ("none", "statement_checked", "proof_checked", "kernel_replayed", "reproducible")


def first_reason(*gates: tuple[str, Column]) -> Column:
    """The name of the first gate whose refusal holds; null if none does. A refusal that is null does not hold."""
    return F.coalesce(*[F.when(F.coalesce(refused, F.lit(False)), name) for name, refused in gates])


def certificate_level(statement: Column, proof: Column, audit: Column, replayed: Column, reproducible: Column) -> Column:
    """The highest level whose conditions, and those of all levels below, are true; the proof needs a passed audit."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    one = yes(statement)
    two = one & yes(proof) & yes(audit)
    three = two & yes(replayed)
    return F.when(three & yes(reproducible), LEVELS[4]).when(three, LEVELS[3]).when(two, LEVELS[2]).when(one, LEVELS[1]).otherwise(LEVELS[0])


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def parity(left: DataFrame, right: DataFrame, key: str, fields: list[str], flags: list[str]) -> DataFrame:
    """key, field, verdict (match, mismatch, unchecked) of each field of two settings; an absent flag is false, another absent field is unchecked."""

    def tall(df: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("false") if f in flags else F.lit(None).cast("string")).alias(name)) for f in [*fields, *flags]]
        return df.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*")

    both = tall(left, "a").join(tall(right, "b"), [key, "field"])
    return both.select(key, "field", F.when(F.col("a").isNull() | F.col("b").isNull(), "unchecked").when(F.col("a") == F.col("b"), "match").otherwise("mismatch").alias("verdict"))
