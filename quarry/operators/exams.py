"""From benchmarks to seeds, and from admitted rows to exam rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import parse
from quarry.functions.filters import in_range, in_split


def benchmark_seeds(rows: DataFrame, key: str, statement: Column, solution: Column, strategy: str, split: tuple[str, list[str]] | None = None, quality: tuple[str, float | None, float | None] | None = None, limit: int | None = None) -> DataFrame:
    """key, statement, answer of a benchmark's rows: those of a split (column, values), then of a quality range (column, low, high), with the answer that the strategy finds in the solution.

    Rows that then lack a statement or an answer are left out, and `limit` takes the first of the others by key.
    """
    kept = rows if split is None else rows.where(in_split(F.col(split[0]), split[1]))
    kept = kept if quality is None else kept.where(in_range(F.col(quality[0]), *quality[1:]))
    found = kept.select(key, F.trim(F.coalesce(statement, F.lit(""))).alias("statement"), parse.answer(solution, F.lit(strategy)).alias("answer")).where("statement <> '' and answer is not null and answer <> ''")
    return found if limit is None else found.orderBy(key).limit(limit)


def exam_rows(rows: DataFrame, key: str, benchmark: str, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Admitted rows (key, benchmark, statement, formal, code) as exam rows with the label of their benchmark; and skipped: benchmark, n of the rows whose benchmark has no label (benchmark, label).

    A formal statement ends before its proof, and what stands before the statement in the code is its header.
    """
    named = labels.select(F.col("benchmark").alias("__b"), "label")
    both = rows.join(named, F.col(benchmark) == F.col("__b"), "left").drop("__b")
    header = F.rtrim(F.regexp_replace(F.coalesce("code", F.lit("")), r"(?s)(^|\n)\s*(theorem|lemma)\s.*$", ""))
    bare = F.rtrim(F.regexp_replace(F.coalesce("formal", F.lit("")), r"(?s):=\s*(by\b.*)?$", ""))
    ready = both.where("label is not null").select(key, F.col("label").alias("benchmark"), "statement", bare.alias("formal"), F.when(header == "", "import Mathlib").otherwise(header).alias("header"))
    return ready, both.where("label is null").groupBy(F.col(benchmark).alias("benchmark")).agg(F.count("*").alias("n"))
