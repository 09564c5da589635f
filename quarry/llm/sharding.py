"""Sharding by extendible hashing, with DataFrame functions only.

A row's hash is the first 32 bits of the MD5 of its id. The directory begins with one bucket of depth 0;
a bucket over the byte limit splits on its next hash bit, the others stay, until every bucket fits or
holds one id. Bytes are first summed per fine cell (many cells to a shard), so that splits are decided on
sums and not on rows; a source or id of any weight is spread by its hash.

Rows: null text has 0 bytes. Rows of one id stay together, as no hash bit parts them: a shard of one id may
exceed the limit (oversized). A null id counts as the empty string. Extra columns are kept by write_shards
and ignored by shard_directory. An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Hash bits that the directory may use.
BITS = 32


def hash_bits(key: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def _prefix(depth: Column) -> Column:
    """The first bits of a hash, as a number."""
    return F.expr("hash").cast("long") / F.pow(F.lit(2), F.lit(BITS) - depth)


def _leaves(cells: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """For each cell (hash without its last BITS - high bits, bytes, n, above): the least depth at which its bucket fits, if any up to high.

    above: whether its bucket of depth low - 1 was too large.
    """
    at = cells.select("hash", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    at = at.withColumn("prefix", F.floor(_prefix(F.col("depth"))))
    sizes = at.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    return at.join(sizes.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)), ["depth", "prefix"])


def shard_directory(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text", fine: int = 64) -> DataFrame:
    """Per row of docs: key, shard_id (its hash-prefix bits, 'root' for none), depth, shard_bytes, oversized."""
    rows = docs.select(F.col(key), hash_bits(key).alias("hash"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    high = min(BITS, max(1, (fine * total // limit + 1).bit_length()))
    low, open_, leaves = 0, rows, None
    while True:
        width = 1 << (BITS - high)
        cells = open_.groupBy((F.floor(F.col("hash") / width) * width).cast("long").alias("hash")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        found = _leaves(cells, limit, low, high).groupBy("hash").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf")).select("hash", "leaf.*")
        found = found.select((F.col("hash") / width).cast("long").alias("cell"), F.lit(high).alias("cell_bits"), "depth", "prefix", "shard_bytes")
        leaves = found if leaves is None else leaves.unionByName(found)
        if high == BITS:
            break
        # cells that are themselves too large go on with more bits; there are few rows in them
        crowded = cells.where(F.col("bytes") > limit).select(F.col("hash").alias("cell_hash"))
        if crowded.isEmpty():
            break
        open_ = open_.withColumn("cell_hash", (F.floor(F.col("hash") / width) * width).cast("long")).join(crowded, "cell_hash", "left_semi").drop("cell_hash")
        low, high = high + 1, min(BITS, high + 12)
    levels = sorted({r.cell_bits for r in leaves.select("cell_bits").distinct().collect()})  # at most a few
    placed = None
    for bits in levels:
        part = rows.select(key, F.floor(F.col("hash") / (1 << (BITS - bits))).cast("long").alias("cell")).join(leaves.where(F.col("cell_bits") == bits), "cell")
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        placed = rows.select(key, F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("shard_bytes"))
    bits = F.lpad(F.bin("prefix"), F.col("depth").cast("int"), "0")
    return placed.select(key, F.when(F.col("depth") == 0, "root").otherwise(bits).alias("shard_id"), F.col("depth").cast("int").alias("depth"), "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """docs as Parquet, one folder to a shard (`shard_id=...`). A column of docs that is named shard_id is written as shard_id_."""
    placed = shard_directory(docs, limit, key, text).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__key"), F.col("shard_id").alias("__shard")).distinct()
    rows = docs.withColumnRenamed("shard_id", "shard_id_").join(placed, F.coalesce(F.col(key).cast("string"), F.lit("")) == F.col("__key")).drop("__key")
    rows.withColumnRenamed("__shard", "shard_id").repartition("shard_id").write.partitionBy("shard_id").parquet(path)
