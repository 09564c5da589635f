"""Scores of episodes: rows pass if any attempt does; denominators are rows, never episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.stats import wilson


def pass_vector(episodes: DataFrame, k: int, seed: str = "seed") -> DataFrame:
    """seed, benchmark (of its first episode), passed within k attempts, attempts."""
    hit = F.coalesce(F.col("success"), F.lit(False))
    return episodes.where(F.col("attempt") <= k).groupBy(seed).agg(F.min_by("benchmark", "attempt").alias("benchmark"), F.max(hit).alias("passed"), F.count("*").alias("attempts"))


def pass_at_k(episodes: DataFrame, k: int) -> DataFrame:
    rows = pass_vector(episodes, k).groupBy("benchmark").agg(F.count("*").alias("n_rows"), F.count_if("passed").alias("n_passed"))
    low, high = wilson(F.col("n_passed"), F.col("n_rows"))
    return rows.select("benchmark", "n_rows", "n_passed", F.round(100 * F.col("n_passed") / F.col("n_rows"), 6).alias("pct"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def revision_yield(episodes: DataFrame) -> DataFrame:
    """Of rows whose first attempt failed, how many a later attempt rescued."""
    hit = F.coalesce(F.col("success"), F.lit(False))
    rows = episodes.groupBy("seed").agg(F.min_by("benchmark", "attempt").alias("benchmark"), F.max(hit & (F.col("attempt") == 1)).alias("first"), F.max(hit).alias("any"))
    out = rows.groupBy("benchmark").agg(F.count("*").alias("n_rows"), F.count_if("first").alias("first_solved"), F.count_if(~F.col("first")).alias("first_failed"), F.count_if(~F.col("first") & F.col("any")).alias("rescued"))
    return out.withColumn("yield_pct", F.round(F.try_divide(100 * F.col("rescued"), F.col("first_failed")), 6))


def lineage_gap(children: DataFrame, parents: DataFrame) -> DataFrame:
    """child, child_solved, roots_solved (all), of children whose every root is resolved.

    children: child, root, child_solved (a row to a root); parents: root, solved.
    """
    met = children.join(parents, "root", "left")
    rows = met.groupBy("child").agg(F.max("child_solved").alias("child_solved"), F.bool_and(F.col("solved").isNotNull()).alias("resolved"), F.bool_and(F.coalesce("solved", F.lit(False))).alias("roots_solved"))
    return rows.where("resolved").drop("resolved")


def total_variation(df: DataFrame, group: Column, key: str) -> DataFrame:
    """Total variation distance between the distributions of key where group is true and where it is false; null if either is empty."""
    counts = df.groupBy(key).agg(F.count_if(group).alias("a"), F.count_if(~group).alias("b"))
    sums = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return counts.join(F.broadcast(sums)).agg(F.round(F.sum(F.abs(F.try_divide("a", "na") - F.try_divide("b", "nb"))) / 2, 9).alias("tvd"))  # one row is broadcast


def trailing_run(df: DataFrame, group: str, ord_: list[str], condition: Column) -> DataFrame:
    """Length of the run at the end of each group in which the condition holds."""
    back = Window.partitionBy(group).orderBy(*map(F.desc, ord_))
    misses = F.sum((~condition).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("__m", misses).groupBy(group).agg(F.count_if(F.col("__m") == 0).alias("tail"), F.count("*").alias("n"))


def streaks(df: DataFrame, group: str, ord_: list[str], condition: Column, least: int) -> DataFrame:
    """Runs of at least `least` rows in which the condition holds: group, streak, length, first and last of ord_[-1]."""
    along = Window.partitionBy(group).orderBy(*ord_)
    marked = df.withColumn("__c", condition).withColumn("__i", F.row_number().over(along))
    runs = marked.where("__c").withColumn("__g", F.col("__i") - F.row_number().over(along))
    return runs.groupBy(group, "__g").agg(F.count("*").alias("length"), F.min(ord_[-1]).alias("first_id"), F.max(ord_[-1]).alias("last_id")).where(F.col("length") >= least).drop("__g")
