"""Frozen cells: compressed files whose bytes are checked against a manifest when they are read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Lines of a bundle that are handed on together.
LINES = 10_000


def freeze(df: DataFrame, path: str, cells: list[str]) -> None:
    """Writes each cell's rows as compressed JSON lines into a folder of its own; fails if something is there."""
    df.repartition(*cells).write.partitionBy(*cells).mode("errorifexists").option("compression", "gzip").json(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file (below path) and content of each bundle; one file is read as a whole."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(path)
    base = path.removeprefix("file:").rstrip("/").replace("//", "/") + "/"
    return rows.select(F.substring_index("path", base, -1).alias("file"), "content")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, n_bytes, sha256 of the bytes of each bundle below path."""
    return _files(spark, path).select("file", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def state_of(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """file, state of each bundle that is there or expected (file, sha256): ok, changed, missing or new."""
    both = expected.select("file", F.col("sha256").alias("__was")).join(manifest(spark, path), "file", "full")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("__was").isNull(), "new").when(F.col("sha256") != F.col("__was"), "changed").otherwise("ok")
    return both.select("file", state.alias("state"))


def _lines(content: bytes) -> Iterator[list[str]]:
    """The lines of a compressed file, some at a time, without the whole text at once. A file that breaks off gives the lines before that."""
    rest, out, at = b"", [], 0
    stream = zlib.decompressobj(31)
    while at < len(content):
        try:
            text = stream.decompress(content[at : at + (1 << 16)])
        except zlib.error:
            break
        at += 1 << 16
        if stream.eof and stream.unused_data:  # another member follows
            content, at, stream = stream.unused_data + content[at:], 0, zlib.decompressobj(31)
        *whole, rest = (rest + text).split(b"\n")
        out += [x.decode("utf-8", "replace") for x in whole]
        if len(out) >= LINES:
            yield out
            out = []
    if out or rest:
        yield [*out, *([rest.decode("utf-8", "replace")] if rest else [])]


def read_frozen(spark: SparkSession, path: str, expected: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of all bundles whose bytes are as expected (file, sha256), with their file; and state_of all bundles, of which those that are not ok have no rows.

    The digest is taken of the very bytes that are read. Blank lines are no rows; a line that is no JSON has null fields.
    """
    kept = _files(spark, path).withColumn("sha256", F.sha2("content", 256)).join(expected.select("file", "sha256"), ["file", "sha256"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for lines in _lines(content):
                    yield pa.record_batch({"file": pa.array([file] * len(lines)), "line": pa.array(lines)})

    lines = kept.select("file", "content").mapInArrow(run, "file string, line string").where(F.trim("line") != "")
    return lines.select(F.col("file").alias("_source_file"), F.from_json("line", schema).alias("r")).select("r.*", "_source_file"), state_of(spark, path, expected)
