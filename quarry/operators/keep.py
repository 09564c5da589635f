"""One row for each key, by the rules that differ: first, last, best, certified over others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; rows with a null key are all kept."""
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    ranked = df.where(known).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank").unionByName(df.where(~known))


def keep_first(df: DataFrame, keys: list[str], *ord_: str) -> DataFrame:
    return keep_by(df, keys, *map(F.asc, ord_))


def keep_last(df: DataFrame, keys: list[str], *ord_: str) -> DataFrame:
    return keep_by(df, keys, *map(F.desc, ord_))


def certified_over_first(df: DataFrame, keys: list[str], certified: Column, *ord_: str) -> DataFrame:
    """The last certified row of each key, or its first row if none is."""
    cert = F.coalesce(certified, F.lit(False))
    marked = df.withColumn("__c", cert)
    sign = [F.when(F.col("__c"), -F.col(o)).otherwise(F.col(o)) for o in ord_]
    return keep_by(marked, keys, F.desc("__c"), *sign).drop("__c")


def unique_fingerprints(df: DataFrame, fp: str, *ord_: str) -> DataFrame:
    """First row of each fingerprint; empty fingerprints are never duplicates."""
    return keep_first(df.where(F.col(fp) != ""), [fp], *ord_).unionByName(df.where(F.col(fp) == ""))


def suffix_duplicates(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """Ids that occur more than once get 10 hex digits of the digest behind them; counts are summed before rows meet."""
    often = df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1")
    return df.join(often, key, "left").withColumn(key, F.when(F.col("__n") > 1, F.concat_ws("_", F.col(key).cast("string"), F.substring(digest, 1, 10))).otherwise(F.col(key).cast("string"))).drop("__n")
