"""Sharding by extendible hashing, with DataFrame functions only.

A row's key hash gives it a string of bits. The directory is indexed by prefixes of those bits: a bucket whose rows have
more bytes than a shard may hold splits on one more bit, others stay as they are. Sums of bytes by 16-bit digits of the
hash are enough to find every leaf: the shortest prefix of a digit whose sum fits. Digits that are too large in themselves (and
only those) go on with the next digit, so the directory grows with the number of oversized buckets, not with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

BITS, DIGITS = 16, 3


def bits_of(key: Column) -> Column:
    """48 hash bits of a key, as a long: the first twelve hexadecimal digits of the MD5 of its text (null: empty)."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), 1, 12), 16, 10).cast("long")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Leaves of rows (columns h: hash bits, n_bytes, n_rows): level, cell (the row's bits up to and with that level's digit), depth, prefix.

    A cell that exceeds the limit with all bits used up (one huge row, or rows of one key) is a leaf of depth 48."""
    found = None
    left = sized.select("h", "n_bytes")
    for level in range(1, DIGITS + 1):
        used = BITS * level
        cells = saved(left.withColumn("cell", F.shiftright("h", 48 - used)).groupBy("cell").agg(F.sum("n_bytes").alias("n_bytes")))
        ups = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(used - BITS), F.lit(used))).alias("depth")).withColumn(
            "prefix", F.expr(f"shiftright(cell, {used} - depth)")
        )
        fits = ups.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("n_bytes")).where((F.col("n_bytes") <= limit) | ((F.col("depth") == used) & F.lit(level == DIGITS)))
        leaf = ups.select("cell", "depth", "prefix").join(fits.select("depth", "prefix"), ["depth", "prefix"])
        leaf = leaf.groupBy("cell").agg(F.min(F.struct("depth", "prefix")).alias("leaf"))
        leaves = saved(leaf.select(F.lit(level).alias("level"), "cell", "leaf.depth", "leaf.prefix"))
        found = leaves if found is None else found.unionByName(leaves)
        over = cells.where(F.col("n_bytes") > limit).select("cell")
        if level == DIGITS or over.isEmpty():
            return found
        left = saved(left.withColumn("cell", F.shiftright("h", 48 - used)).join(over, "cell", "left_semi").drop("cell"))


def shard(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = 1 << 20) -> DataFrame:
    """One row per row of docs: key, n_bytes (UTF-8, null: 0), shard (the leaf's bits as text), depth, shard_bytes, shard_rows.

    Rows of one key share a shard. A shard exceeds the limit only if its rows can't be told apart by 48 bits of hash or if it is one row.
    A null key is a key; an empty table gives no shard; other columns are ignored."""
    sized = saved(docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).withColumn("h", bits_of(F.col("key"))))
    found = directory(sized, limit)
    parts = []
    depth = found.agg(F.max("level")).first()[0] or 1
    for level in range(1, depth + 1):
        leaves = found.where(F.col("level") == level).drop("level")
        parts.append(sized.withColumn("cell", F.shiftright("h", 48 - BITS * level)).join(leaves, "cell").drop("cell"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("substring(lpad(bin(prefix), 48, '0'), 49 - depth, depth)"))
    rows = rows.withColumn("shard", bits)
    sums = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return rows.join(sums, "shard").select(F.col("key").alias(key), "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")
