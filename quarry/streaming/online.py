"""Streaming forms: first-wins deduplication and runs of failures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions.text import fingerprint


def online_dedup(stream: DataFrame, text: str = "text", within: str | None = None) -> DataFrame:
    """Rows whose fingerprint is new; empty ones always pass. within: a watermarked column that bounds the state."""
    marked = stream.withColumn("fp", fingerprint(F.col(text)))
    # an empty text is given a key of its own
    keyed = marked.withColumn("fp_key", F.when(F.col("fp") == "", F.expr("uuid()")).otherwise(F.col("fp")))
    return (keyed.dropDuplicatesWithinWatermark(["fp_key"]) if within else keyed.dropDuplicates(["fp_key"])).drop("fp_key")


def failure_streaks(stream: DataFrame, key: str, failed: str, order: str, abort: int = 3) -> DataFrame:
    """key, streak, aborted after each batch: failures in a row by the order column, as a batch keeps none; state is one number to a key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, aborted = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")[failed].to_numpy(bool)
        good = np.flatnonzero(~rows)
        ends = np.r_[good, len(rows)]
        runs = np.diff(np.r_[-1, ends]) - 1  # failures before each success, and after the last
        runs[0] += streak
        aborted = bool(aborted or (runs >= abort).any())
        streak = int(runs[-1])
        state.update((streak, aborted))
        yield pd.DataFrame({key: [k[0]], "streak": [streak], "aborted": [aborted]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, streak long, aborted boolean", "streak long, aborted boolean", "update", GroupStateTimeout.NoTimeout)


def episode_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """An append-only log of JSON lines in a folder, as a stream; writers add whole files and need no lock."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def latest_outcomes(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key and its last value by the order column; later records update earlier ones. For output mode update or complete."""
    return stream.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def resume_into(stream: DataFrame, path: str, checkpoint: str, key: str) -> DataStreamWriter:
    """A writer that appends to Parquet each batch's rows whose key is not there yet; a batch that is written again after a failure adds nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates([key])
        try:
            rows = rows.join(batch.sparkSession.read.parquet(path).select(key), key, "left_anti")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        rows.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
