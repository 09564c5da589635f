"""The test tables seen as the engine's entities, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: a seed is a user's day; a purchase solves it, an error is a failure of transport."""
    ev = table(spark, sf_dir, "events").withColumn("day", F.dayofyear("ts"))
    ev = ev.withColumn("seed", F.col("user_id") * 1000 + F.col("day"))
    order = F.row_number().over(Window.partitionBy("seed").orderBy("ts", "event_id"))
    return ev.select(
        "seed", order.alias("attempt"), F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("benchmark"), (F.col("user_id") % 2).cast("int").alias("arm"),
        (F.floor(F.col("user_id") / 2) * 1000 + F.col("day")).alias("pair"), F.concat(F.lit("b"), (F.floor(F.col("user_id") / 2) % 3).cast("string")).alias("pair_benchmark"),
        (F.col("event_type") == "purchase").alias("success"), F.col("event_type").alias("outcome"), F.col("value").alias("elapsed"), "user_id", "event_id", "ts", "props",
    )


EPISODES = """e AS (SELECT user_id * 1000 + dayofyear(ts) AS seed, row_number() OVER (PARTITION BY user_id * 1000 + dayofyear(ts) ORDER BY ts, event_id) AS attempt,
  'b' || (user_id % 3) AS benchmark, (user_id % 2)::INT AS arm, (user_id // 2) * 1000 + dayofyear(ts) AS pair, 'b' || ((user_id // 2) % 3) AS pair_benchmark,
  event_type = 'purchase' AS success, event_type AS outcome, value AS elapsed, user_id, event_id, ts, props FROM events)"""
