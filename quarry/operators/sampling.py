"""Stratified and balanced selection by keyed hash, and equal-count bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.ranking import places


def draw(seed: str, key: str) -> Column:
    """A repeatable order of rows."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")))


def round_robin(df: DataFrame, stratum: str, cell: str, quota: int, key: str, seed: str) -> DataFrame:
    """quota rows of each stratum: one of each cell in turn, cells of more rows first, rows by draw."""
    sizes = df.groupBy(stratum, cell).agg(F.count("*").alias("__size"))
    within = F.row_number().over(Window.partitionBy(stratum, cell).orderBy(draw(seed, key), key))
    turns = df.withColumn("__round", within).where(F.col("__round") <= quota).join(sizes, [stratum, cell])
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("__round", F.desc("__size"), cell))
    return turns.withColumn("place", place).where(F.col("place") <= quota).drop("__round", "__size")


def equal_count_bins(df: DataFrame, group: str, value: str, tie: str, bins: int, least: int = 3) -> DataFrame:
    """Consecutive chunks of max(1, n div bins) rows of each group; a last chunk of under `least` rows is left out."""
    out = places(df, group, value, tie).withColumn("bin", F.floor(F.col("place") / F.greatest(F.lit(1), F.floor(F.col("size") / bins))))
    kept = out.groupBy(group, "bin").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    return out.join(kept, [group, "bin"]).drop("place", "size")


def smoothed(hits: Column, tries: Column, prior: float, base: float) -> Column:
    return (hits + prior * base) / (tries + prior)
