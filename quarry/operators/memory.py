"""Memory of judgements: an append-only log whose entries are resolved by later outcomes, and cards for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def resolved(log: DataFrame, outcomes: DataFrame, key: str, order: str) -> DataFrame:
    """log with outcome: each outcome goes to the earliest entry of its key that came before it and is still open. Other entries stay open (null), other outcomes are left out, as are empty ones.

    Entries and outcomes lie on one time line, an entry before an outcome of its time. Their balance along it (one up for an entry, one down for an outcome) has a
    new low just where an outcome finds no open entry; the n-th of the other outcomes goes to the n-th entry.
    """
    line = log.select(key, order, F.lit(1).alias("__up"), F.lit(None).cast(outcomes.schema["outcome"].dataType).alias("outcome"))
    line = line.unionByName(outcomes.where(F.col("outcome").isNotNull() & (F.col("outcome").cast("string") != "")).select(key, order, F.lit(-1).alias("__up"), "outcome"))
    along = Window.partitionBy(key).orderBy(order, F.desc("__up"), "outcome")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    balance = line.withColumn("__at", F.sum("__up").over(so_far)).withColumn("__low", F.coalesce(F.min("__at").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = balance.where((F.col("__up") < 0) & (F.col("__at") >= F.least("__low", F.lit(0)))).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order, "outcome")))
    entries = log.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return entries.join(taken.select(key, "__n", "outcome"), [key, "__n"], "left").drop("__n")


def recent(log: DataFrame, operator: str, order: str, window: int) -> DataFrame:
    """The last `window` entries of each operator, with prior: 1 for those that are resolved, 0.5 for open ones."""
    back = F.row_number().over(Window.partitionBy(operator).orderBy(F.desc(order)))
    return log.withColumn("back", back).where(F.col("back") <= window).withColumn("prior", F.when(F.col("outcome").isNotNull(), 1.0).otherwise(0.5))


def card(row: dict[str, Column], metadata: Column) -> dict[str, Column]:
    """A card's columns from a row's fields over a metadata map, which only fills what the row lacks; its key is of the formal text, or else of the statement."""
    field = lambda name: F.coalesce(F.nullif(row[name], F.lit("")) if name in row else F.lit(None), F.element_at(metadata, name))
    out = {name: field(name) for name in ("id", "family", "target", "statement", "formal")}
    out["family"] = F.coalesce(out["family"], F.lit("unknown"))
    out["digest"] = F.sha2(F.lower(F.regexp_replace(F.coalesce(out["formal"], out["statement"], F.lit("")), r"\s+", " ")), 256)
    return out


def compact(flags: Column, most: int = 6) -> Column:
    return F.slice(F.coalesce(flags, F.array().cast("array<string>")), 1, most)
