"""Structured Streaming forms of rollups and of the page cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache import latest


def rollup_stream(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour", slide: str | None = None, keys: list[str] = ()) -> DataFrame:
    """Counts of events in tumbling or sliding windows, with a watermark for late ones."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide or size), *keys).agg(F.count(F.lit(1)).alias("n"))


def versions(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """The newest whole version of a cache (-1: none) and the batches written after it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return -1, []
    names = [s.getPath() for s in fs.listStatus(folder)]
    done = [p.getName() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    whole = max((int(n[2:]) for n in done if n.startswith("v=")), default=-1)
    return whole, sorted(int(n[2:]) for n in done if n.startswith("d=") and int(n[2:]) > whole)


def cached_pages(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest row of each page of a cache that ``cache_writer`` keeps, up to a batch; null where there is none."""
    whole, after = versions(spark, path)
    parts = [f"{path}/v={whole}"] * (whole >= 0) + [f"{path}/d={n}" for n in after if before is None or n < before]
    if not parts:
        return None
    out = spark.read.parquet(parts[0])
    for p in parts[1:]:
        out = out.unionByName(spark.read.parquet(p))
    return latest(out)


def cache_writer(path: str, every: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges fetched pages into a cache, which ``cached_pages`` reads.

    A batch writes its own rows only (``d=`` and its number).  Every so many
    batches the whole cache is written anew (``v=``), so its size is not paid for
    by each batch.  What is there already decides what a batch builds on, so a
    batch that is missing or runs again loses no page.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(batch).write.mode("overwrite").parquet(f"{path}/d={number}")
        whole, after = versions(spark, path)
        if number > whole and len(after) >= every:
            cached_pages(spark, path).write.mode("overwrite").parquet(f"{path}/v={number}")

    return write
