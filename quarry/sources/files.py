"""Sources with explicit schemas and an order column, and sinks that refuse to lose rows."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False) -> DataFrame:
    """Rows of JSON lines, plain or gzipped; blank lines are no rows. tolerant: broken lines are skipped, else they fail."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    bad = T.StructField("_corrupt_record", T.StringType())
    rows = spark.read.schema(T.StructType([*schema.fields, bad])).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and cells of several lines in quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """By suffix: Parquet, JSON lines or CSV; another suffix is an error."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".jsonl", ".jsonl.gz", ".json")):
        return read_jsonl(spark, path, schema)
    if path.endswith(".csv"):
        return read_csv(spark, path, schema)
    raise ValueError(f"no reader for {path}")


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """path of each file below root; only names are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")


def read_cards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tolerant JSON lines: a missing file has no rows; broken lines, and lines that are no objects, are skipped."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = lines.where(F.trim("value").startswith("{")).select(F.from_json("value", bad, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).where("r._bad is null")
    return rows.select("r.*").drop("_bad")


def data_files(spark: SparkSession, root: str, patterns: list[str]) -> list[str]:
    """Paths below root that the first pattern with any finds (patterns of the path below root, * for anything); an error if none does. File names of a data set are few."""
    paths = [r.path for r in _listed(spark, root).collect()]
    base = root.removeprefix("file:").rstrip("/")
    for p in patterns:
        found = sorted(x for x in paths if fnmatch.fnmatch(x.removeprefix("file:").replace("//", "/").removeprefix(base).lstrip("/"), p))
        if found:
            return found
    raise FileNotFoundError(f"no data below {root} for {patterns}")


def discover(spark: SparkSession, root: str, schema: T.StructType, exclude: tuple[str, ...] = (), skip: str = "burned") -> DataFrame:
    """Rows of all JSON lines below root, with their file, without files that are excluded by name or have `skip` in their path."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(root).select("*", F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_name").alias("_name"))
    return rows.where(~F.col("_source_file").contains(skip) & ~F.col("_name").isin(*exclude)).drop("_name")


def cell_episodes(spark: SparkSession, raw: str, bundle: str, schema: T.StructType) -> DataFrame:
    """A cell's episodes: from its raw folder, or else from its frozen bundle, or none; backups (names with more after .jsonl) are left out."""
    for path in (raw, bundle):
        try:
            names = [r.path for r in _listed(spark, path).where(F.col("path").rlike(r"\.jsonl(\.gz)?$")).collect()]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if names:
            return spark.read.schema(schema).json(names)
    return spark.createDataFrame([], schema)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Benchmarks of a JSON catalogue: name, path, split, filters (column, keep, low, high) and answer strategy."""
    rule = "struct<column:string,keep:array<string>,low:double,high:double>"
    return spark.read.schema(f"name string, path string, split {rule}, quality {rule}, answer string").option("multiLine", True).json(path)


def with_order(df: DataFrame) -> DataFrame:
    """df with the file, the block and the row within it that each row came from, for rules of first and last."""
    return df.withColumns({"ord_file": F.col("_metadata.file_path"), "ord_block": F.col("_metadata.file_block_start"), "ord_id": F.monotonically_increasing_id()})


def read_campaigns(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """Campaigns by name, united, each row with its campaign and file; a path may be a glob."""
    bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parts = [spark.read.schema(bad).json(p).select("*", F.lit(name).alias("_campaign"), F.col("_metadata.file_path").alias("_source_file")).where("_corrupt_record is null").drop("_corrupt_record") for name, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_guarded(df: DataFrame, path: str, key: str, protected: DataFrame | None = None) -> None:
    """Writes JSON lines by key; fails if a protected row would be lost or something is there."""
    if protected is not None and not protected.join(df, key, "left_anti").isEmpty():
        raise ValueError("protected rows would be lost")
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").json(path)


def write_split(df: DataFrame, path: str, key: str, accepted: Column) -> None:
    """Accepted and rejected rows in folders of their own, each by key; a null verdict is a rejection."""
    for name, rows in (("accepted", df.where(F.coalesce(accepted, F.lit(False)))), ("rejected", df.where(~F.coalesce(accepted, F.lit(False))))):
        write_guarded(rows, f"{path}/{name}", key)


def write_groups(df: DataFrame, plan: DataFrame, path: str, key: str) -> None:
    """CSV in a folder to each group of the plan (group, key) all of whose ids have a row; other groups are left out."""
    whole = plan.join(df.select(key).distinct().withColumn("__has", F.lit(True)), key, "left").groupBy("group").agg(F.bool_and(F.coalesce("__has", F.lit(False))).alias("ok")).where("ok").select("group")
    plan.join(whole, "group", "left_semi").join(df, key).repartition("group").write.partitionBy("group").option("header", True).csv(path)


def flattened(df: DataFrame, limit: int = 10) -> DataFrame:
    """df for CSV: lists joined by ; up to a limit, structs opened, maps as JSON."""

    def cells(name: str, kind: T.DataType, c: Column) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in cells(f"{name}_{f.name}", f.dataType, c[f.name])]
        if isinstance(kind, T.ArrayType):
            own = c.cast("array<string>") if not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)) else F.transform(c, lambda x: F.to_json(x))
            return [F.array_join(F.slice(own, 1, limit), ";").alias(name)]
        return [(F.to_json(c) if isinstance(kind, T.MapType) else c).alias(name)]

    return df.select(*[x for f in df.schema.fields for x in cells(f.name, f.dataType, F.col(f.name))])


def frozen(df: DataFrame, *keys: str) -> DataFrame:
    """keys, n, digest of each cell: SHA-256 over sums of its rows' hashes, so it is of the rows and not of their order, and merges before any shuffle."""
    row = F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in keys]))
    parts = [F.sum(F.xxhash64(row, F.lit(i)).cast("decimal(38,0)")) for i in range(4)]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[p.cast("string") for p in parts]), 256).alias("digest"))


def differing(manifest: DataFrame, now: DataFrame, *keys: str) -> DataFrame:
    """keys, state (missing, new or changed) of the cells that are not as the manifest has them."""
    both = manifest.alias("a").join(now.alias("b"), list(keys), "full")
    state = F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "new").when(F.col("a.digest") != F.col("b.digest"), "changed")
    return both.select(*keys, state.alias("state")).where("state is not null")


def unchanged(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """after; fails if a row of before is lost or one of the frozen columns has changed in it."""
    met = before.select(key, *[F.col(c).alias(f"__{c}") for c in columns]).join(after.withColumn("__there", F.lit(True)), key, "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    if not met.where(F.col("__there").isNull() | ~same).isEmpty():
        raise ValueError(f"frozen columns have changed: {columns}")
    return after
