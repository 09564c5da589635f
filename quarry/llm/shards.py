"""Queries answered by every shard of an index, shard by shard in the tasks that hold them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


def answered(index: DataFrame, queries: DataFrame, keys: list[str], order: str, build: Callable[[pa.Table], Any], solve: Callable[[Any, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, parts: int) -> DataFrame:
    """What solve(built shard, some queries) gives for all shards and their queries.

    Both tables name their shard in keys; a query is there once for each shard that it asks. A shard's index rows
    come first, by `order`, and its queries follow in any number of batches, so that a task holds one shard and one batch of queries at a time.
    """
    rows = index.withColumn("__query", F.lit(False)).unionByName(queries.withColumn("__query", F.lit(True)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, built = None, [], None
        for batch in batches:
            marks = list(zip(*[batch.column(k).to_pylist() for k in keys], batch.column("__query").to_pylist(), strict=True))
            at = 0
            while at < len(marks):
                end = at
                while end < len(marks) and marks[end] == marks[at]:
                    end += 1
                shard, part = marks[at][:-1], batch.slice(at, end - at)
                if shard != now:
                    now, held, built = shard, [], None
                if not marks[at][-1]:
                    held.append(part)
                elif held or built is not None:
                    if built is None:
                        built, held = build(pa.Table.from_batches(held)), []
                    yield from solve(built, part)
                at = end

    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "__query", order).mapInArrow(run, schema)


def matrix(column: pa.ChunkedArray | pa.Array, width: int):
    """A column of lists of one length as an array of that width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, width)
