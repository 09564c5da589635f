"""Choosing rows: seeds, quotas, groups, ranked rules and lessons. Every order has a last, unique key, so choices repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.ranking import places


def first_distinct(df: DataFrame, surface: Column, n: int, *order: Column) -> DataFrame:
    """The first n rows by order, of which each surface counts once."""
    once = df.withColumn("__s", surface).withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy(*order))).where("__r = 1").drop("__s", "__r")
    return once.orderBy(*order).limit(n)


def quotas(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """stratum, size, quota: shares of total in proportion to size, one at least and no more than there are; shares left over go to the largest remainders. Strata are few."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    exact = F.col("size") * total / F.sum("size").over(Window.partitionBy())
    base = sizes.withColumn("__exact", exact).withColumn("__base", F.greatest(F.lit(1), F.floor("__exact")))
    left = F.lit(total) - F.sum("__base").over(Window.partitionBy())
    order = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("__exact") - F.col("__base")), stratum))
    return base.withColumn("quota", F.least(F.col("size"), F.col("__base") + (order <= left).cast("long"))).select(stratum, "size", "quota")


def by_quota(df: DataFrame, stratum: str, total: int, *order: Column) -> DataFrame:
    """df cut to the quota of each stratum, in order."""
    along = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return df.withColumn("place", along).where(F.col("place") <= total).join(F.broadcast(quotas(df, stratum, total)), stratum).where(F.col("place") <= F.col("quota")).drop("size", "quota")


def deal(df: DataFrame, value: str, tie: str, groups: int) -> DataFrame:
    """df with group and round: rows by descending value are dealt in turn, back and forth, so that groups are alike."""
    ranked = places(df.withColumn("__one", F.lit(1)).withColumn("__down", -F.col(value)), "__one", "__down", tie).drop("__one", "__down", "size")
    turn, at = F.floor(F.col("place") / groups), F.col("place") % groups
    return ranked.withColumn("round", turn).withColumn("group", F.when(turn % 2 == 0, at).otherwise(groups - 1 - at)).drop("place")


def balanced(df: DataFrame, family: str, want: int, have: DataFrame, *order: Column) -> DataFrame:
    """want rows, always of the family that has least so far (family, have), families in alphabetical order where equal.

    The k-th row of a family is taken when the family has have + k - 1; so rows go by that number.
    """
    along = F.row_number().over(Window.partitionBy(family).orderBy(*order))
    rows = df.withColumn("k", along).where(F.col("k") <= want).join(have, family, "left").withColumn("level", F.coalesce("have", F.lit(0)) + F.col("k") - 1)
    return rows.orderBy("level", family, "k").limit(want).drop("k", "have")


def best_candidates(df: DataFrame, key: str, score: str, palette: list[str]) -> DataFrame:
    """key, score (its greatest), hits (of the palette in the key): those with most hits first, then of greatest score."""
    hits = sum((F.col(key).contains(p).cast("int") for p in palette), F.lit(0))
    return df.groupBy(key).agg(F.max(score).alias(score)).withColumn("hits", hits)


def ranked_rules(rules: DataFrame, weight: Column, most: int = 8, least: int = 4) -> DataFrame:
    """The rules (rule, category) of positive weight, `most` at best; where these are under `least`, the first of each category's others fill up. Rules are a small table."""
    scored = rules.withColumn("score", weight)
    order = Window.partitionBy().orderBy(F.desc("score"), "rule")
    first = F.when(F.col("score") > 0, F.row_number().over(order))
    kept = scored.withColumn("__r", first).withColumn("__n", F.sum((F.col("score") > 0).cast("int")).over(Window.partitionBy()))
    spare = F.row_number().over(Window.partitionBy(F.col("score") > 0, "category").orderBy("rule"))
    filled = kept.withColumn("__spare", F.when(F.col("score") <= 0, spare))
    turn = F.row_number().over(Window.partitionBy(F.col("score") > 0).orderBy("__spare", "rule"))
    place = F.coalesce("__r", F.col("__n") + F.when(F.col("score") <= 0, turn))
    return filled.withColumn("place", place).where((F.col("__r") <= most) | (F.col("__r").isNull() & (F.col("place") <= least))).drop("__r", "__n", "__spare")


def lessons(observed: Column, general: list[str], by_flag: dict[str, str], limit: int) -> Column:
    """Lessons of the flags observed, in their order, then general ones, once each and `limit` at most."""
    known = F.create_map(*[F.lit(x) for item in by_flag.items() for x in item])
    own = F.filter(F.transform(observed, lambda f: F.element_at(known, f)), lambda x: x.isNotNull())
    return F.slice(F.array_distinct(F.concat(own, F.array(*map(F.lit, general)))), 1, limit)


def pool(df: DataFrame, key: str, family: str, signature: str, weak: Column, cap: int, *order: Column) -> DataFrame:
    """df with role: selected, or why not (weak, duplicate_signature, family_cap); a signature's first row counts, and `cap` rows of a family."""
    sound = df.withColumn("__weak", F.coalesce(weak, F.lit(False)))
    same = F.row_number().over(Window.partitionBy("__weak", signature).orderBy(*order, key))
    sound = sound.withColumn("__dup", ~F.col("__weak") & (same > 1))
    within = F.row_number().over(Window.partitionBy("__weak", "__dup", family).orderBy(*order, key))
    role = F.when(F.col("__weak"), "weak").when(F.col("__dup"), "duplicate_signature").when(within > cap, "family_cap").otherwise("selected")
    return sound.withColumn("role", role).drop("__weak", "__dup")
