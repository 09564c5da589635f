"""Assembly of a release: rows with all evidence about them, the judges' two passes, the gate with its reason, and one row to a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.gates import first_reason


def last_verdicts(runs: DataFrame, key: str, order: str) -> DataFrame:
    """The last verdict of each key and n_flips, how often a verdict of the key differs from the one before."""
    along = Window.partitionBy(key).orderBy(order)
    rows = runs.withColumn("__flip", (F.lag("verdict").over(along) != F.col("verdict")).cast("int"))
    return rows.groupBy(key).agg(F.max_by("verdict", order).alias("verdict"), F.sum(F.coalesce("__flip", F.lit(0))).alias("n_flips"))


def overlay(rows: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """rows with, for each table (key and more, a row to a key), has_<name> and its columns; what a table does not have is null, which means not measured."""

    def join(df: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, evidence = item
        return df.join(evidence.withColumn(f"has_{name}", F.lit(True)), key, "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))

    return reduce(join, tables.items(), rows)


def judged(rows: DataFrame, key: str, run1: DataFrame, run2: DataFrame) -> DataFrame:
    """rows that both passes judged (key, strong, keep), with strong1, keep1, strong2, keep2."""
    for i, run in ((1, run1), (2, run2)):
        rows = rows.join(run.select(key, F.col("strong").alias(f"strong{i}"), F.col("keep").alias(f"keep{i}")), key)
    return rows


def admitted_by_both() -> Column:
    return F.col("strong1") & F.col("strong2") & F.col("keep1") & F.col("keep2")


def gate() -> Column:
    """Why a judged row is not admitted, null if it is. Reads has_roundtrip, roundtrip, has_exclusion, redundant, and both passes."""
    return first_reason(
        ("roundtrip_false", F.col("has_roundtrip") & ~F.col("roundtrip")), ("roundtrip_unknown", F.col("has_roundtrip") & F.col("roundtrip").isNull()), ("excluded", F.col("has_exclusion")), ("redundant", F.col("redundant")),
        ("not_strong", ~F.col("strong1") & ~F.col("strong2")), ("judges_disagree", F.col("strong1") != F.col("strong2")), ("not_kept", ~F.coalesce(admitted_by_both(), F.lit(False))),
    )


def one_to_a_text(rows: DataFrame, text: str, *order: Column) -> DataFrame:
    """The best row of each text by the given order; rows without a text stay. Texts are told apart by digest."""
    best = F.row_number().over(Window.partitionBy(F.sha2(text, 256)).orderBy(*order))
    return rows.where(F.col(text).isNull() | (F.col(text) == "")).unionByName(rows.where(F.col(text) != "").withColumn("__r", best).where("__r = 1").drop("__r"))


def resolve_parents(sources: list[DataFrame], key: str) -> DataFrame:
    """key, parent, origin: the parent that the first of the sources (key, parent) has for each key; origin is its place in the list."""
    tagged = [s.select(key, "parent", F.lit(i).alias("origin")) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged).where("parent is not null")
    return rows.groupBy(key).agg(F.min_by("parent", "origin").alias("parent"), F.min("origin").alias("origin"))


def benchmark_of_roots(rows: DataFrame, key: str, roots: str, benchmarks: DataFrame) -> DataFrame:
    """key, benchmark: the one benchmark (root, benchmark) of all roots, `mixed` if they have several, `unknown` if one has none."""
    each = rows.select(key, F.explode_outer(roots).alias("root")).join(benchmarks, "root", "left").groupBy(key)
    found = each.agg(F.collect_set("benchmark").alias("b"), F.bool_or(F.col("benchmark").isNull()).alias("missing"))
    return found.select(key, F.when(F.col("missing"), "unknown").when(F.size("b") == 1, F.col("b")[0]).otherwise("mixed").alias("benchmark"))


def migrate_ids(rows: DataFrame, key: str, parent: str, suffix: Column, restarts: Column) -> DataFrame:
    """key, new: a row whose parent is no row keeps its id; others append suffix to the new id of their parent or, where restarts holds, to the id at the root of their chain.

    Ids come by doubling (see along), in rounds of the logarithm of the longest chain. Rows on or below a cycle have null.
    """
    from quarry.operators.fixpoint import along

    part = lambda head, cut, tail: F.struct(head.cast("string").alias("head"), cut.alias("cut"), tail.alias("tail"))
    join = lambda own, upper: part(upper["head"], own["cut"] | upper["cut"], F.when(own["cut"], own["tail"]).otherwise(F.concat(upper["tail"], own["tail"])))
    found = along(rows, key, parent, part(F.lit(None), F.coalesce(restarts, F.lit(False)), suffix), part(F.col(key), F.lit(False), F.lit("")), join)
    return found.select(key, F.concat("value.head", "value.tail").alias("new"))


def rewritten(rows: DataFrame, key: str, ids: str, mapping: DataFrame) -> DataFrame:
    """key, ids: lists of ids with those replaced that mapping (old, new; a row to an old id) has, in their order; null and empty lists stay."""
    each = rows.select(key, F.posexplode(ids).alias("__at", "old")).join(mapping.select("old", "new"), "old", "left")
    lists = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("new", "old").alias("id")))), lambda x: x["id"]).alias("__new"))
    return rows.join(lists, key, "left").select(key, F.coalesce("__new", ids).alias(ids))


def rewritten_keys(rows: DataFrame, key: str, entries: str, mapping: DataFrame) -> DataFrame:
    """key, entries: maps with their keys replaced by mapping (old, new); of entries that then share a key the one of the least old key stays; null and empty maps stay."""
    each = rows.select(key, F.explode(entries).alias("old", "__value")).join(mapping.select("old", "new"), "old", "left")
    one = each.groupBy(key, F.coalesce("new", "old").alias("__key")).agg(F.min_by("__value", "old").alias("__value"))
    maps = one.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__key", "__value")))).alias("__new"))
    return rows.join(maps, key, "left").select(key, F.coalesce("__new", entries).alias(entries))
