"""Sharding by extendible hashing.

A document's hash names its bucket by a prefix of bits.  Sizes are summed once per
prefix of ``STEP`` bits; from these sums every shorter prefix follows, and a bucket is
split on another bit only while it holds more than the limit.  Prefixes that are
still too large get the next ``STEP`` bits.  Texts are not moved to decide this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import stored

STEP = 16
BITS = 64


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, size in bytes and hash of every row; copies of one row get hashes of their own."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                       F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                       F.monotonically_increasing_id().alias("row"))
    rows = stored(rows)
    again = stored(rows.groupBy("doc_id", "text_hash").count().where("count > 1").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")))
    same = rows["doc_id"].eqNullSafe(again["__id"]) & (rows["text_hash"] == again["__hash"])
    return rows.join(again, same, "left").select(
        "doc_id", "text_hash", "n_bytes",
        F.xxhash64("doc_id", "text_hash", F.when(F.col("__hash").isNotNull(), F.col("row"))).alias("hash"))


def _prefix(hash_column: str, bits: int):
    return F.shiftrightunsigned(hash_column, BITS - bits) if bits else F.lit(0).cast("long")


def directory(rows: DataFrame, limit: int, depth: int) -> DataFrame:
    """For the prefixes of ``depth + STEP`` bits in ``rows``: the bucket each belongs to.

    ``rows`` lie in buckets of ``depth`` bits that are too large.  Returns cell, bits
    (NULL: too large with ``depth + STEP`` bits, too), shard_bytes and shard_docs.
    """
    full = depth + STEP
    cells = stored(rows.groupBy(_prefix("hash", full).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")))
    levels = cells.withColumn("bits", F.explode(F.sequence(F.lit(depth), F.lit(full)))).withColumn(
        "prefix", F.expr(f"shiftrightunsigned(cell, {full} - bits)"))
    buckets = stored(levels.groupBy("bits", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.lit(full) == BITS) & (F.col("bits") == full)
    chosen = levels.select("cell", "bits", "prefix").join(buckets.where(fits), ["bits", "prefix"]).groupBy("cell").agg(
        F.min(F.struct("bits", "shard_bytes", "shard_docs")).alias("s"))
    return cells.select("cell").join(chosen, "cell", "left").select("cell", "s.*")


def assign_shards(docs: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, shard, shard_bytes, shard_docs.

    ``shard`` is the bucket's bit prefix as a string of 0 and 1; no bucket holds more
    than ``limit`` bytes of text, except that a single larger document is a bucket of its own.
    All documents within the limit are one bucket with the empty prefix.  NULL texts have no bytes;
    repeated rows are documents of their own; other columns are ignored.
    """
    rows, done, depth = _hashed(docs), None, 0
    while depth < BITS:
        rows = stored(rows)
        cells = stored(directory(rows, limit, depth).withColumnRenamed("cell", "__cell"))
        placed = rows.join(cells, _prefix("hash", depth + STEP) == F.col("__cell")).drop("__cell")
        fit = placed.where("bits IS NOT NULL").select(
            "doc_id", "text_hash", "n_bytes",
            F.expr("left(lpad(bin(hash), 64, '0'), bits)").alias("shard"), "shard_bytes", "shard_docs")
        done = fit if done is None else done.unionByName(fit)
        if cells.where("bits IS NULL").isEmpty():
            break
        rows = placed.where("bits IS NULL").select("doc_id", "text_hash", "n_bytes", "hash")
        depth += STEP
    return done


def write_shards(docs: DataFrame, path: str, limit: int = 64 << 20) -> None:
    """Write the rows of ``docs`` in folders ``shard=<prefix>`` under ``path`` (the empty prefix as ``_``).

    Rows that agree in doc_id and text go to one of their shards.
    """
    shards = assign_shards(docs, limit).groupBy("doc_id", "text_hash").agg(F.min("shard").alias("shard")).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
        F.when(F.col("shard") == "", F.lit("_")).otherwise(F.col("shard")).alias("shard"))
    same = docs["doc_id"].eqNullSafe(shards["__id"]) & (F.xxhash64(docs["text"]) == shards["__hash"])
    found = docs.join(shards, same).select(*docs.columns, "shard")
    found.repartition("shard").write.partitionBy("shard").parquet(path)
