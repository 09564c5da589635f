"""From documents to packed training sequences, in five stages."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.ngram_join import keep_one
from quarry.llm.packing import pack
from quarry.llm.passages import cut_repeats
from quarry.llm.perplexity import keep_good
from quarry.llm.queries import WORD_BPE
from quarry.llm.scratch import Scratch, fresh_space
from quarry.llm.secrets import redact


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with a folder of its own for its tables, in place of that of the stage before, whose rows have been written."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        fresh_space(spark)
        return work(spark, docs, sf_dir)

    return run


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is that of trusted text."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id and text, of each group of near copies (five words, 0.8)."""
    return keep_one(docs, k=5, pct=80)


@_stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of passages of 50 words or more."""
    return _recount(cut_repeats(docs))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by a mask."""
    return _recount(redact(docs))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, mixed from all sources."""
    return pack(docs, WORD_BPE(), with_ids=False)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, and those of the stage before go."""
    docs, results = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, apart=True)
    before: tuple[str, ...] = ()
    for name, stage in STAGES[:-1]:
        docs = results.table(stage(spark, docs, sf_dir), name)
        results.drop(*before)
        before = (name,)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokeniser are beyond SQL.
ORACLE_SQL = None
