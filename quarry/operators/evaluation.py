"""Summaries of evaluation and proof runs. A row is a seed under one arm; its accuracy is the mean over its attempts, and it passes if any of them does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def row_scores(episodes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, seed, arm, accuracy and passed over the first k attempts of each row."""
    hit = F.coalesce(F.col("success"), F.lit(False))
    return episodes.where(F.col("attempt") <= k).groupBy(*keys, "seed", "arm").agg(F.avg(hit.cast("int")).alias("accuracy"), F.max(hit).alias("passed"))


def evaluation_summary(episodes: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """keys; n, accuracy and pass_pct of arm 0 (control) and arm 1 (treatment), and how many points the treatment drops. An arm that was not run is null."""
    rows = row_scores(episodes, keys, k)
    of = lambda arm, c: F.when(F.col("arm") == arm, F.col(c))
    cells = [x for arm in (0, 1) for x in (
        F.count_if(F.col("arm") == arm).alias(f"n_{arm}"), F.round(100 * F.avg(of(arm, "accuracy")), 6).alias(f"accuracy_{arm}"), F.round(100 * F.avg(of(arm, "passed").cast("int")), 6).alias(f"pass_{arm}"),
    )]
    drop = lambda c: F.avg(of(0, c).cast("double")) - F.avg(of(1, c).cast("double"))
    return rows.groupBy(*keys).agg(*cells, F.round(100 * drop("accuracy"), 6).alias("drop_accuracy"), F.round(100 * drop("passed"), 6).alias("drop_pass"))


def proof_summary(runs: DataFrame, keys: list[str], turns: str, passed: Column, clean: Column, outcome: str) -> DataFrame:
    """keys, what, n: rows, passes, clean rows, the histogram of turns (1 to 4, 5 and more) and the counts of outcomes, in one pass over runs."""
    turn = F.concat(F.lit("turns_"), F.least(F.col(turns), F.lit(5)).cast("string"))
    counted = F.array(F.lit("rows"), F.when(passed, "passes"), F.when(clean, "clean"), turn, F.concat(F.lit("outcome_"), F.col(outcome)))
    return runs.select(*keys, F.explode(F.array_compact(counted)).alias("what")).groupBy(*keys, "what").agg(F.count("*").alias("n"))


def progress(done: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_done, n_empty, target, remaining of every cell of targets (keys, target). done: a row to an attempt, with `empty`."""
    have = done.groupBy(*keys).agg(F.count_if(~F.col("empty")).alias("n_done"), F.count_if("empty").alias("n_empty"))
    cells = targets.join(have, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_done", "n_empty")})
    return cells.withColumn("remaining", F.greatest(F.col("target") - F.col("n_done"), F.lit(0)))


def direction_rates(rows: DataFrame, direction: str, flags: list[str]) -> DataFrame:
    """direction, n, and of each boolean flag its count, the rows where it is known, and its rate; a rate without rows is null."""
    parts = [x for f in flags for x in (F.count_if(f).alias(f"n_{f}"), F.count(f).alias(f"known_{f}"), F.round(F.try_divide(F.count_if(f), F.count(f)), 6).alias(f"rate_{f}"))]
    return rows.groupBy(direction).agg(F.count("*").alias("n"), *parts)


def histogram(rows: DataFrame, field: str) -> DataFrame:
    """value, n: how often each value is in a field, which may be a list; nulls and blanks are left out."""
    values = F.explode(field) if rows.schema[field].dataType.typeName() == "array" else F.col(field)
    return rows.select(values.alias("value")).where("value is not null and value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def effort(nodes: Column, turns: Column) -> tuple[Column, Column]:
    """The mean of nodes explored, or else turns used, and which of the two it is."""
    some = F.size(F.coalesce(nodes, F.array().cast("array<double>"))) > 0
    mean = F.aggregate(nodes, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(nodes)
    return F.when(some, mean).otherwise(turns.cast("double")), F.when(some, "nodes").otherwise("turns")
