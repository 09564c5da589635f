"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_space: contextvars.ContextVar[str] = contextvars.ContextVar("space", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one machine (tests) takes a temporary folder; on a cluster it is an error, as no machine's own folder is shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Operators called inside put their tables into one folder, which goes at the end: write results before.

    with workspace(spark):
        cut_repeats(docs).write.parquet(path)
    """
    space = _space.set(f"/quarry-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, shared_dir(spark) + _space.get())
        _space.reset(space)


def fresh_space(spark: SparkSession) -> None:
    """Later operators put their tables into a new folder, and the one that such a call began before goes: what was read from it must have been written."""
    if _space.get():
        _delete(spark, shared_dir(spark) + _space.get())
    _space.set(f"/quarry-{uuid.uuid4().hex}")


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Of what runs inside, each query's shuffle files go as it ends, and not when the driver happens to collect its garbage. Nothing that runs inside may be cached."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Writes tables as Parquet, so that lineage is cut by files that outlive any executor, and drops them on demand. apart: outside of any space or workspace."""

    def __init__(self, spark: SparkSession, apart: bool = False):
        self.spark, self.paths, self.apart = spark, {}, apart

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}{'' if self.apart else _space.get()}/quarry-{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                _delete(self.spark, path)
