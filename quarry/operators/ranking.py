"""Exact places in sorted groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def places(df: DataFrame, group: str, value: str, tie: str, buckets: int = 64) -> DataFrame:
    """df with place, from 0, in its group by value and tie, and size, the rows of its group. Null values are last.

    A group is not sorted in one task: its quantiles part it into buckets, which are sorted apart, and the rows of the buckets before are added.
    The quantiles are approximate, the places are not.
    """
    cuts = df.groupBy(group).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 1_000).alias("__cuts"))
    rows = df.join(cuts, group, "left").withColumn("__bucket", F.when(F.col(value).isNull(), buckets).otherwise(F.size(F.filter(F.coalesce("__cuts", F.array().cast(cuts.schema["__cuts"].dataType)), lambda c: c < F.col(value)))))
    counts = rows.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    along = Window.partitionBy(group).orderBy("__bucket")  # `buckets` rows of a group
    before = counts.select(group, "__bucket", (F.sum("__n").over(along) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(group)).alias("size"))
    within = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(value, tie))
    return rows.withColumn("__i", within).join(before, [group, "__bucket"]).withColumn("place", F.col("__i") - 1 + F.col("__before")).drop("__cuts", "__bucket", "__i", "__before")
