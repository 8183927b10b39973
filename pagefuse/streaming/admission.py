"""Admission of streamed calls in the order of their own times, with typed state and event-time timers.

Calls may come shuffled: each waits as state until the watermark has passed
its time, then the calls of a key are decided in order of (time, id).  So the
result does not depend on how the stream was cut into batches or when they
ran, and it is that of the batch form, ``quota.admitted``, on all calls that
are not later than the watermark allows.  Later ones are dropped by Spark and
counted as ``numRowsDroppedByWatermark``.

A key that is quiet for two windows is forgotten by a timer of event time, not
by the wall clock: what it would have remembered has no effect by then.

The state store must be RocksDB (``with_state_store``); calls without a time
are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ADMITTED = "key string, ts long, id long, admitted boolean"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers and typed state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Waiting(StatefulProcessor):
    """Keeps calls until their time has passed; subclasses decide them in order."""

    #: Schema of the value that decisions go by, and milliseconds after which a quiet key is forgotten.
    memory = "times array<long>"
    keep_ms = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        """State: waiting call ids by time, the value that decisions go by, and the time of the last decision."""
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long", "ids array<long>")
        self.own = handle.getValueState("own", self.memory)
        self.last = handle.getValueState("last", "ts long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        """Calls wait, one timer for each time."""
        new: dict[int, list[int]] = {}
        for batch in rows:
            for t, own in batch.groupby("ts")["id"]:
                new.setdefault(int(t), []).extend(own.tolist())
        for t, own in new.items():
            held = list(self.waiting.getValue((t,))[0]) if self.waiting.containsKey((t,)) else []
            self.waiting.updateValue((t,), (held + own,))
            self.handle.registerTimer(1000 * t)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """Decide the calls of the second that has passed; a timer that finds none is one that may forget the key."""
        now = expiredTimerInfo.getExpiryTimeInMs()  # timers fire in order of their times
        t = now // 1000
        if now % 1000 or not self.waiting.containsKey((t,)):
            if self.last.exists() and 1000 * self.last.get()[0] + self.keep_ms <= now:
                self.own.clear()
                self.last.clear()
            return
        ids = sorted(self.waiting.getValue((t,))[0])
        own, ok = self.decide(self.own.get() if self.own.exists() else None, t, len(ids))
        self.waiting.removeKey((t,))
        self.own.update(own)
        self.last.update((t,))
        self.handle.registerTimer(1000 * t + self.keep_ms)
        yield pd.DataFrame({"key": key[0], "ts": t, "id": ids, "admitted": [k < ok for k in range(len(ids))]})

    def decide(self, own: tuple | None, t: int, n: int) -> tuple[tuple, int]:
        """The new value, and how many of the ``n`` calls of second ``t`` are let through."""
        raise NotImplementedError

    def close(self) -> None:
        """Nothing to close."""


class SlidingWindow(Waiting):
    """At most ``limit`` admitted calls in any ``seconds``, both ends included; it remembers seconds and their calls."""

    memory = "times array<long>, calls array<long>"

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.seconds, self.keep_ms = limit, seconds, 2000 * seconds + 1000

    def decide(self, own: tuple | None, t: int, n: int) -> tuple[tuple, int]:
        """Calls before the window no longer count."""
        held = [(s, c) for s, c in zip(*own, strict=True) if s >= t - self.seconds] if own else []
        ok = min(n, self.limit - sum(c for _, c in held))
        held += [(t, ok)] * (ok > 0)
        return ([s for s, _ in held], [c for _, c in held]), ok


class TokenBucket(Waiting):
    """Tokens flow in evenly, ``per_minute`` of them, and ``burst`` at most are held; a call takes one."""

    memory = "at long, tokens double"

    def __init__(self, per_minute: int, burst: int | None) -> None:
        self.rate, self.most = per_minute / 60, float(burst or per_minute)
        self.keep_ms = int(1000 * self.most / self.rate) + 1000  # full again

    def decide(self, own: tuple | None, t: int, n: int) -> tuple[tuple, int]:
        """As many calls as there are whole tokens."""
        tokens = min(self.most, own[1] + (t - own[0]) * self.rate) if own else self.most
        ok = min(n, int(tokens + 1e-9))
        return (t, tokens - ok), ok


def decided(calls: DataFrame, processor: Waiting, key: str, ts: str, order: str, late: str) -> DataFrame:
    """Every call of a stream, decided by a processor."""
    d = calls.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("at"), F.col(order).cast("long").alias("id"))
    d = d.where("at IS NOT NULL").withColumn("ts", F.col("at").cast("long")).withWatermark("at", late)
    return d.groupBy("key").transformWithStateInPandas(processor, ADMITTED, "Append", "EventTime")


def admitted_stream(calls: DataFrame, key: str = "key", ts: str = "ts", order: str = "id", limit: int = 20, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """``key``, ``ts``, ``id`` and ``admitted``: the sliding window over a stream whose calls come up to ``late`` out of order."""
    return decided(calls, SlidingWindow(limit, seconds), key, ts, order, late)


def token_bucket_stream(calls: DataFrame, key: str = "key", ts: str = "ts", order: str = "id", per_minute: int = 20, burst: int | None = None, late: str = "10 minutes") -> DataFrame:
    """``key``, ``ts``, ``id`` and ``admitted``: the token bucket over such a stream."""
    return decided(calls, TokenBucket(per_minute, burst), key, ts, order, late)
