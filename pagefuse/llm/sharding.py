"""Sharding by rendezvous hashing of stable keys over weighted shards (native).

Each record scores every shard with a hash of (key, shard) and goes to the
highest score, so a new shard only takes records into itself.  With weights w
the score is -w / ln(u) for u uniform in (0, 1): a shard gets records in
proportion to its weight, and a changed weight moves only what it must.

Edge cases: a null key counts as the text ``null``; a null text has 0 bytes;
repeated rows with one key share a shard and get slots of their own; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless

#: Leading hexadecimal digits of the hash that make u: 52 bits, exact in a double.
DIGITS = 13


def _draw(key: Column, shard: int) -> Column:
    """52 uniform bits for a key and a shard."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, DIGITS), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, 0 to ``len(weights) - 1``, of a key.  Ties go to the higher shard number."""
    if len(set(weights)) == 1:  # the highest draw wins; no logarithm is needed
        scored = [F.struct(F.substring(F.md5(F.concat(key, F.lit(f":{s}"))), 1, DIGITS).alias("score"), F.lit(s).alias("shard")) for s in range(len(weights))]
    else:
        scored = [F.struct((-F.lit(float(w)) / F.log((_draw(key, s) + F.lit(0.5)) / F.lit(2.0**52))).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return F.array_max(F.array(*scored))["shard"]


def assign_shards(df: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", sub_digits: int = 3) -> DataFrame:
    """Shard, gapless slot in it, size and checksum of each record.

    Slots follow the order of md5(key) within a shard.  They are numbered in
    16 ** ``sub_digits`` ranges of that hash for each shard, so no shard is
    gathered in one task.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(
        F.col(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        F.md5(key).alias("__order"),
        *([rendezvous(key, grown).alias("grown_shard")] if grown else []),
    )
    d = d.withColumn("__sub", F.substring("__order", 1, sub_digits))
    out = gapless(d, ["shard"], "__sub", ["__order", "text_crc32"], "slot")
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), *(["grown_shard"] if grown else []))


def write_shards(df: DataFrame, path: str, weights: list[float], id_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write ``df`` to one folder for each shard; a shard is split over tasks by a second hash."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    d = df.withColumn("shard", rendezvous(key, weights)).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(64)))
    d.repartition("shard", "__part").drop("__part").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def moved(df: DataFrame, before: list[float], after: list[float], id_col: str = "doc_id") -> DataFrame:
    """Records that change places between two sets of weights, counted for each pair of shards."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    pairs = df.select(rendezvous(key, before).alias("from_shard"), rendezvous(key, after).alias("to_shard"))
    return pairs.groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("n"))
