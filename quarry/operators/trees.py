"""Trees of JSON."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def _once(pairs: list[tuple]) -> dict:
    fields = dict(pairs)
    if len(fields) < len(pairs):
        raise ValueError("a field comes twice")
    return fields


def _no_number(text: str) -> None:
    raise ValueError(text)


_DECODER = json.JSONDecoder(object_pairs_hook=_once, parse_constant=_no_number)


def _has(text: str | None, name: str) -> bool:
    """If a field of this name has a value that is not null, false, 0 or empty. A list with an empty list in it is not empty."""
    try:
        todo = [_DECODER.raw_decode((text or "").lstrip(" \t\n\r"))[0]]
    except (ValueError, RecursionError):
        return False
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            if node.get(name):
                return True
            todo.extend(node.values())
        elif isinstance(node, list):
            todo.extend(node)
    return False


def has_content(tree: Column, name: str) -> Column:
    @F.arrow_udf("boolean")
    def run(trees: pa.Array) -> pa.Array:
        return pa.array([_has(t, name) for t in trees.to_pylist()], pa.bool_())

    return run(tree)


def names_with_content(rows: DataFrame, key: str, tree: str, name: str) -> DataFrame:
    """key, found: if the tree (JSON text) of a row has a field of this name that says something, at any depth. Text that is no JSON, or has a field twice, has none.

    Each tree is walked inside its row, so that nothing is shuffled; trees whose text lacks the name are not walked.
    """
    may = F.contains(F.col(tree), F.lit(f'"{name}"')) | F.contains(F.col(tree), F.lit("\\u"))
    return rows.select(key, F.coalesce(has_content(F.when(may, F.col(tree)), name), F.lit(False)).alias("found"))
