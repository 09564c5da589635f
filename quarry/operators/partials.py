"""Statistics that are kept as mergeable parts: a new campaign is added without reading the old ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def partial(rows: DataFrame, groups: list[str], conditions: list[str], distinct: str | None = None) -> DataFrame:
    """groups, n and, for each condition (a column that may be null), n_<c> of those that hold and known_<c> of those that are known; ids, a sketch of how many distinct values a column has."""
    cells = [c for name in conditions for c in (F.count_if(name).alias(f"n_{name}"), F.count(name).alias(f"known_{name}"))]
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), *cells, *([F.hll_sketch_agg(distinct, 14).alias("ids")] if distinct else []))


def merged(parts: list[DataFrame], groups: list[str]) -> DataFrame:
    """Parts of the same columns as one part: counts add up and sketches are united."""
    whole = reduce(DataFrame.unionByName, parts)
    cells = [F.hll_union_agg(c).alias(c) if c == "ids" else F.sum(c).alias(c) for c in whole.columns if c not in groups]
    return whole.groupBy(*groups).agg(*cells)


def rates(part: DataFrame, conditions: list[str]) -> DataFrame:
    """part with rate_<c>, null where nothing is known, and n_ids in place of its sketch."""
    out = part.withColumns({f"rate_{c}": F.try_divide(f"n_{c}", f"known_{c}") for c in conditions})
    return out.withColumn("n_ids", F.hll_sketch_estimate("ids")).drop("ids") if "ids" in part.columns else out


def add_campaign(spark: SparkSession, path: str, campaign: str, part: DataFrame) -> None:
    """Puts a campaign's part into the table at path, in place of what it had for this campaign; other campaigns are not touched."""
    part.write.mode("overwrite").parquet(f"{path.rstrip('/')}/campaign={campaign}")


def all_campaigns(spark: SparkSession, path: str, groups: list[str]) -> DataFrame:
    """The part of all campaigns at path."""
    return merged([spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/campaign=*").drop("campaign")], groups)
