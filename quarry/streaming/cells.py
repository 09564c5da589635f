"""Runs of cells as streams: what a cell has done so far, when it gives up, and when it is over. Needs the RocksDB state store (state_store)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the state store that keeps states of any size outside of the heap.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Queries that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class CellRuns(StatefulProcessor):
    """One value to a cell: records so far, failures, failures in a row and if it has given up; and one timer, which closes the cell when nothing comes for `idle` milliseconds."""

    def __init__(self, cell: str, failed: str, order: str, abort: int, idle: int):
        self.cell, self.failed, self.order, self.abort, self.idle = cell, failed, order, abort, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "n long, failures long, streak long, aborted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, failures, streak, aborted = self.state.get() if self.state.exists() else (0, 0, 0, False)
        gave_up = False
        for bad in pd.concat(list(rows)).sort_values(self.order, kind="stable")[self.failed]:
            n, failures, streak = n + 1, failures + bool(bad), streak + 1 if bad else 0
            gave_up = gave_up or (streak >= self.abort and not aborted)
        self.state.update((n, failures, streak, aborted or gave_up))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        for event in ("progress", *(["abort"] if gave_up else [])):
            yield self._row(key, event, n, failures, streak)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, failures, streak, _ = self.state.get()
        self.state.clear()
        yield self._row(key, "closed", n, failures, streak)

    def close(self) -> None:
        pass

    def _row(self, key, event: str, n: int, failures: int, streak: int) -> pd.DataFrame:
        return pd.DataFrame({self.cell: [key[0]], "event": [event], "n": [n], "failures": [failures], "streak": [streak]})


def cell_runs(stream: DataFrame, cell: str, failed: str, order: str, abort: int = 3, idle: int = 600_000) -> DataFrame:
    """cell, event, n, failures, streak: `progress` after each batch that has records of the cell, `abort` once when `abort` of them in a row have failed, and `closed` when none came for `idle` milliseconds.

    Rows of a batch count in the order of a column. A cell that is heard of again after it was closed begins anew. Null in failed is no failure.
    """
    kind = T.StructType([stream.schema[cell], T.StructField("event", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n", "failures", "streak")]])
    whole = stream.fillna(False, [failed])
    return whole.groupBy(cell).transformWithStateInPandas(CellRuns(cell, failed, order, abort, idle), kind, "Append", "ProcessingTime")


def append_once(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataStreamWriter:
    """A writer that appends to Parquet the first record of each key. Which keys are known is state beside the checkpoint and what was written is in the sink's log, so a run that goes on after a failure reads neither the sink nor old input and gives each record once."""
    return stream.dropDuplicates(keys).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
