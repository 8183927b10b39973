"""Serving pages from a stream: fresh ones from state, failed fetches by the stale page, if it is not too old.

Two streams meet by page address: requests (``id``, ``canonical_url``, ``at``) and
outcomes of fetches (``request_id``, ``canonical_url``, ``at``, ``ok``, ``markdown``).  What
comes shuffled waits until the watermark has passed its time and is then taken
in order of time, outcomes before requests of the same second:

* a request finds a page not older than ``ttl``: ``cache``;
* else it waits for its outcome: ``fetched`` when that is good, and when it is bad,
  or has not come ``deadline`` seconds later, ``cache_stale`` if the page is not older
  than ``stale`` times ``ttl``, or ``error``.

A good outcome is the page's new state, whether a request still waits for it or
not; a page that is too old to serve is forgotten by a timer of event time.
So the answers don't depend on batches or on the wall clock.  Rows later than
the watermark allows are dropped by Spark, and so are rows without a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.cache import STALE, TTL

ANSWERS = "id long, canonical_url string, asked long, answered long, action string, markdown string, fetched_at long"


class Serving(StatefulProcessor):
    """State of a page: rows that wait for their time, requests that wait for their outcome, and the page."""

    def __init__(self, ttl: int, stale: int, deadline: int) -> None:
        self.ttl, self.stale, self.deadline = ttl, stale, deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Typed state."""
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long", "kinds array<int>, ids array<long>, oks array<boolean>, bodies array<string>")
        self.open = handle.getMapState("open", "id long", "asked long")
        self.page = handle.getValueState("page", "markdown string, fetched_at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        """Rows wait, one timer for each time."""
        new: dict[int, list[list]] = {}
        for batch in rows:
            for t, kind, i, ok, body in zip(batch["ts"], batch["kind"], batch["id"], batch["ok"], batch["markdown"], strict=True):
                for column, x in zip(new.setdefault(int(t), [[], [], [], []]), (int(kind), int(i), bool(ok), body), strict=True):
                    column.append(x)
        for t, own in new.items():
            if self.waiting.containsKey((t,)):
                own = [list(a) + b for a, b in zip(self.waiting.getValue((t,)), own, strict=True)]
            self.waiting.updateValue((t,), tuple(own))
            self.handle.registerTimer(1000 * t)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """Take the rows of the second that has passed, then give up on requests whose deadline it is.

        A timer that is set while timers fire may come after those of later
        seconds, so deadlines that lie before this second are met first.
        """
        t = expiredTimerInfo.getExpiryTimeInMs() // 1000
        page = self.page.get() if self.page.exists() else None
        out: list[tuple] = []

        def answer(i: int, asked: int, now: int, action: str) -> None:
            out.append((i, key[0], asked, now, action, *(page if page and action != "error" else (None, None))))

        def failed(i: int, asked: int, now: int) -> None:
            answer(i, asked, now, "cache_stale" if page and now - page[1] <= self.ttl * self.stale else "error")

        def give_up(upto: int) -> None:
            due = [(asked + self.deadline, i, asked) for (i,), (asked,) in self.open.iterator() if asked + self.deadline <= upto]
            for now, i, asked in sorted(due):
                self.open.removeKey((i,))
                failed(i, asked, now)

        give_up(t - 1)
        if self.waiting.containsKey((t,)):
            rows = sorted(zip(*self.waiting.getValue((t,)), strict=True), key=lambda r: r[:2])
            self.waiting.removeKey((t,))
            for kind, i, ok, body in rows:
                if kind:  # a request
                    if page and t - page[1] <= self.ttl:
                        answer(i, t, t, "cache")
                    else:
                        self.open.updateValue((i,), (t,))
                        self.handle.registerTimer(1000 * (t + self.deadline))
                    continue
                if ok:
                    page = (body, t)
                    self.page.update(page)
                    self.handle.registerTimer(1000 * (t + self.ttl * self.stale + 1))
                if self.open.containsKey((i,)):
                    asked = self.open.getValue((i,))[0]
                    self.open.removeKey((i,))
                    answer(i, asked, t, "fetched") if ok else failed(i, asked, t)
        give_up(t)
        if page and t - page[1] > self.ttl * self.stale:
            self.page.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    def close(self) -> None:
        """Nothing to close."""


def served(requests: DataFrame, outcomes: DataFrame, ttl: int = TTL, stale: int = STALE, deadline: int = 30, late: str = "10 minutes") -> DataFrame:
    """One answer for each request of a stream; the session needs ``admission.with_state_store``."""
    at = F.col("at").cast("timestamp")
    r = requests.select("canonical_url", at.alias("at"), F.lit(1).alias("kind"), F.col("id").cast("long").alias("id"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("string").alias("markdown"))
    o = outcomes.select("canonical_url", at.alias("at"), F.lit(0).alias("kind"), F.col("request_id").cast("long").alias("id"), F.coalesce("ok", F.lit(False)).alias("ok"), "markdown")
    d = r.unionByName(o).where("at IS NOT NULL AND canonical_url IS NOT NULL").withColumn("ts", F.col("at").cast("long")).withWatermark("at", late)
    return d.groupBy("canonical_url").transformWithStateInPandas(Serving(ttl, stale, deadline), ANSWERS, "Append", "EventTime")
