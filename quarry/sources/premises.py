"""Answers of premise search services, whose shape differs, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fields of an answer, in the order in which they are looked for.
FIELDS = {"kind": ("kind",), "signature": ("signature",), "type": ("type",), "informal_name": ("informal_name",), "informal_description": ("informal_description", "docstring"), "value": ("value",)}


def _is_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def _is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _name(v: Column, field: str) -> Column:
    """A name that is text, or a list of parts that are joined by dots; blank parts are none."""
    parts = F.filter(F.try_variant_get(v, f"$.{field}", "array<string>"), lambda p: F.trim(p) != "")
    return F.coalesce(F.array_join(parts, "."), F.trim(F.try_variant_get(v, f"$.{field}", "string")), F.lit(""))


def premises(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """key, place, name, module_name and FIELDS: a row for each named candidate in a row's payload (JSON text).

    A payload is a list of candidates, or a list of one such list; a candidate may be wrapped in `result`. What is no list, no object or has no name is left out.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows  # a small file of answers is one piece
    whole = rows.select(F.col(key), F.try_parse_json(payload).alias("__v")).where(_is_list(F.col("__v")))
    first, second = (F.try_variant_get("__v", f"$[{i}]", "variant") for i in (0, 1))
    single = _is_list(first) & second.isNull()
    items = whole.select(key, F.when(single, first).otherwise(F.col("__v")).alias("__v"))
    each = items.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()).select(F.col("pos").alias("place"), F.col("value").alias("__item"))).where(_is_object(F.col("__item")))
    inner = F.try_variant_get("__item", "$.result", "variant")
    found = each.select(key, "place", F.when(inner.isNull() | F.is_variant_null(inner), F.col("__item")).otherwise(inner).alias("__r")).where(_is_object(F.col("__r")))
    field = lambda names: F.coalesce(*[F.nullif(F.try_variant_get("__r", f"$.{n}", "string"), F.lit("")) for n in names], F.lit(""))
    named = found.select(key, "place", _name(F.col("__r"), "name").alias("name"), _name(F.col("__r"), "module_name").alias("module_name"), *[field(n).alias(c) for c, n in FIELDS.items()])
    return named.where("name <> ''")
