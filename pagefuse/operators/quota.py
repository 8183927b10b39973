"""Sliding-window request quotas in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import admission

LIMIT, WINDOW = 20, 60


def calls_in_window(calls: DataFrame, key: str = "key", ts: str = "ts", seconds: int = WINDOW) -> DataFrame:
    """Each call with the number of calls of its key in the ``seconds`` before it, both ends included.

    A key is cut into stretches of 64 windows, so one with very many calls is
    spread over its time; only calls in the last window of a stretch are sorted
    with the next one as well.
    """
    length = 64 * max(seconds, 1)
    own = F.floor(F.col(ts) / length)
    parts = F.when(F.col(ts) - own * length >= length - seconds, F.array(own, own + 1)).otherwise(F.array(own))
    d = calls.withColumn("__own", own).withColumn("__part", F.explode(parts))
    w = Window.partitionBy(key, "__part").orderBy(ts).rangeBetween(-seconds, 0)
    return d.withColumn("in_window", F.count(F.lit(1)).over(w)).where("__own = __part").drop("__own", "__part")


def pruned(calls: DataFrame, now: int, ts: str = "ts", seconds: int = WINDOW) -> DataFrame:
    """The log without calls older than two windows."""
    return calls.where(F.col(ts) >= now - 2 * seconds)


def wait_hint(calls: DataFrame, now: int, key: str = "key", ts: str = "ts", limit: int = LIMIT, seconds: int = WINDOW) -> DataFrame:
    """Seconds until a slot frees for each key: 0 below the limit, else when the oldest of the newest ``limit`` calls leaves.

    The newest calls are a bounded part of a key's window.
    """
    recent = calls.where(F.col(ts).between(now - seconds, now))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))
    top = recent.withColumn("__r", rank).where(F.col("__r") <= limit)
    waits = top.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("oldest"))
    return waits.select(key, F.when(F.col("n") < limit, F.lit(0)).otherwise(F.greatest(F.col("oldest") + seconds - now, F.lit(0)) + 1).cast("long").alias("wait_s"))


def admitted(calls: DataFrame, key: str = "key", ts: str = "ts", order: str = "id", limit: int = LIMIT, seconds: int = WINDOW) -> DataFrame:
    """Which calls a limiter lets through that counts admitted calls only; ``admission`` says how a key is spread over tasks."""
    return admission.admitted(calls, key, ts, order, limit, seconds)
