"""Sharding by weighted rendezvous hashing of record keys.

Each (key, shard) pair has a pseudo-random draw u in (0, 1), and a key goes to the shard with the
largest weight / -ln(u). A draw depends on nothing else, so adding a shard moves only the keys
that the new shard wins, removing one moves only its own, and a weight changes only what it must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import read_table


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight; the smallest wins."""
    h = F.xxhash64(key, shard.cast("int"))
    return -F.ln((F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)) / weight


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key; a weight of 0 gets nothing. Ties (equal costs) go to the smaller shard."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")
    open_shards = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights) if w > 0])
    return F.array_min(F.transform(open_shards, lambda x: F.struct(_cost(key, x["s"], x["w"]).alias("c"), x["s"].alias("s"))))["s"]


def shards(docs: DataFrame, n: int = 40, *, weights: list[float] | None = None, rows_per_bucket: int = 20_000) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: doc_id and the number of shards decide. size is the text's UTF-8 bytes plus 16
    (null text: 16, and its crc32 is that of no bytes). grown_shard is the shard with one shard more
    (of weight 1). Slots count a shard's rows from 0 without gaps: rows fall into sub-buckets by
    hash, small counts of each give its first slot, and rows are numbered inside a sub-bucket, so no
    task holds a shard. A null doc_id is a key of its own; rows that repeat a doc_id share its shard
    and get different slots. Extra columns are ignored; an empty table gives no rows.
    """
    weights = [1.0] * n if weights is None else weights
    if len(weights) != n:
        raise ValueError("one weight for each shard")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.encode("text", "utf-8"), F.lit(b""))).alias("text_crc32"))
    buckets = max(1, -(-docs.count() // (n * rows_per_bucket)))
    key, last = F.col("doc_id"), F.lit(n)
    best = rendezvous(key, weights)
    rows = rows.withColumn("shard", best)
    won = _cost(key, last, F.lit(1.0)) < _cost(key, F.col("shard"), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("shard") + 1))
    rows = rows.withColumn("grown_shard", F.when(won, last).otherwise(F.col("shard")))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    out = rows.withColumn("place", F.row_number().over(inside) - 1).join(first, ["shard", "bucket"])
    return out.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(read_table(spark, sf_dir, "documents"), 40)
