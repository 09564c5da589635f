"""Iteration to a fixpoint, with every round's rows kept in files that outlive any executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from math import ceil, log2
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one machine takes a temporary folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-rounds-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, which cuts its lineage."""
    path = f"{_folder(df.sparkSession)}/quarry-round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def until_empty(first: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """first and all that step makes of each round's new rows, until it makes none. A row whose keys are known is not new, so that cycles end; the round that found it first counts."""
    out = now = stored(first.dropDuplicates(keys))
    while True:
        now = stored(step(now).dropDuplicates(keys).join(out, keys, "left_anti"))
        if now.isEmpty():
            return out
        out = out.unionByName(now)


def along(rows: DataFrame, key: str, parent: str, own: Column, own_of_root: Column, join: Callable[[Column, Column], Column], done: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, value, cycle: for each row, join folded over its own value and those of all rows above it, as far as a row whose parent is no row.

    Pointers double: after r rounds each row's value spans 2 ** r rows and points at the next one, so that chains of n rows take log2(n) rounds. join(own,
    upper) must be associative. Rows that still point anywhere when all chains must have ended lie on a cycle or below one: cycle is true and
    value null. done tells of values that nothing above can change (join gives own for them): their chains end there, and so cost no more rounds. key is unique.
    """
    ended = (lambda to, value: F.when(done(value), None).otherwise(to)) if done else (lambda to, _: to)
    ids = rows.select(F.col(key).alias("__up"), F.lit(True).alias("__there"))
    pointed = rows.join(ids, F.col(parent) == F.col("__up"), "left")
    here = F.col("__there").isNotNull()
    first = pointed.select(F.col(key), F.when(here, F.col(parent)).alias("to"), F.when(here, own).otherwise(own_of_root).alias("value"))
    now = stored(first.withColumn("to", ended(F.col("to"), F.col("value"))))
    settled, open_, n = now.where("to is null"), now.where("to is not null"), now.count()
    for _ in range(ceil(log2(n + 1)) + 1):
        if open_.isEmpty():
            break
        upper = settled.unionByName(open_).select(F.col(key).alias("to"), F.col("to").alias("next"), F.col("value").alias("upper"))
        further = open_.join(upper, "to").select(key, F.col("next").alias("to"), join(F.col("value"), F.col("upper")).alias("value"))
        now = stored(further.withColumn("to", ended(F.col("to"), F.col("value"))))
        settled, open_ = settled.unionByName(now.where("to is null")), now.where("to is not null")
    lost = open_.select(key, F.lit(None).cast(now.schema["value"].dataType).alias("value"), F.lit(True).alias("cycle"))
    return settled.select(key, "value", F.lit(False).alias("cycle")).unionByName(lost)


def nearest(rows: DataFrame, key: str, parent: str, **marks: Column) -> DataFrame:
    """key, cycle and, for each mark (a condition), its name with the nearest row at or above that has it, and steps_<name>, how far up that is; null where there is none.

    A search ends where all marks are found; one that has not found them and comes to a cycle finds none.
    """
    cell = lambda m: F.struct(F.when(m, F.col(key)).alias("at"), F.when(m, 0).otherwise(1).alias("steps"))

    def join(own: Column, upper: Column) -> Column:
        further = lambda n: F.when(own[n]["at"].isNotNull(), own[n]).otherwise(F.struct(upper[n]["at"].alias("at"), (own[n]["steps"] + upper[n]["steps"]).alias("steps")))
        return F.struct(*[further(n).alias(n) for n in marks])

    own = F.struct(*[cell(F.coalesce(m, F.lit(False))).alias(n) for n, m in marks.items()])
    all_found = lambda value: reduce(and_, [value[n]["at"].isNotNull() for n in marks])
    found = along(rows, key, parent, own, own, join, all_found)
    shown = [c for n in marks for c in (F.col(f"value.{n}.at").alias(n), F.when(F.col(f"value.{n}.at").isNotNull(), F.col(f"value.{n}.steps")).alias(f"steps_{n}"))]
    return found.select(key, "cycle", *shown)
