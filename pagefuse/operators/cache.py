"""The page cache: newest row of each page, freshness, look-up, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL, STALE = 7200, 2


def freshness(age: Column, ttl: int = TTL, stale: int = STALE) -> Column:
    """``fresh`` up to the TTL, ``stale`` up to ``stale`` times it (for failures only), ``expired`` beyond; null without a row."""
    return F.when(age.isNull(), F.lit(None)).when(age <= ttl, F.lit("fresh")).when(age <= ttl * stale, F.lit("stale")).otherwise(F.lit("expired"))


def latest(rows: DataFrame, key: str = "canonical_url", at: str = "fetched_at", ties: list[str] = ()) -> DataFrame:
    """The newest row of each key; an aggregate with partial sums, so a hot key does not gather in one task.

    Rows of one time go by ``ties``, then by the other columns that have an order (maps have none).
    """
    rest = [c for c in rows.columns if c not in (key, at, *ties)]
    ordered = [c for c in rest if not any(k in rows.schema[c].dataType.simpleString() for k in ("map<", "variant"))]
    top = rows.groupBy(key).agg(F.max_by(F.struct(at, *ties, *rest), F.struct(at, *ties, *ordered)).alias("__r"))
    return top.select(*[F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in rows.columns])


def upserted(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after new rows replaced those of the same page."""
    return latest(cache.unionByName(new))


def looked_up(requests: DataFrame, cache: DataFrame, now: Column, ttl: int = TTL, stale: int = STALE, failed: str | None = None) -> DataFrame:
    """Requests with their cached row and what to do: ``cache``, ``cache_stale`` (only after a failure) or ``fetch``."""
    c = cache.select(F.col("canonical_url").alias("__u"), *[F.col(x).alias(f"cached_{x}") for x in cache.columns if x != "canonical_url"])
    j = requests.join(c, F.col("canonical_url") == F.col("__u"), "left").drop("__u")
    state = freshness(now - F.col("cached_fetched_at"), ttl, stale)
    lost = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    return j.withColumn("cache_state", state).withColumn("action", F.when(state == "fresh", F.lit("cache")).when((state == "stale") & lost, F.lit("cache_stale")).when(lost, F.lit("error")).otherwise(F.lit("fetch")))
