"""The requests of one query to many engines at a time, each under its own timeout and all under one deadline.

A query's requests go to one task, which sends them at once and takes the
replies as they come.  An engine that has not answered by its timeout, or by the
query's deadline, is a row with the error ``engine timed out``; the others'
replies stand.  A task has ``at_once`` queries under way, so slow engines of
one query don't hold up the next.

Edge cases: a null timeout is the deadline; a null address is an invalid one;
a query without requests has no rows; columns besides the four are not read.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .http import Limits, Reply, read

TIMED_OUT = "engine timed out"
SCHEMA = "query_id long, engine string, status int, content_type string, body binary, error string, is_rate_limited boolean, seconds double"


@dataclass
class Query:
    """A query under way: its open requests by future, with the time by which each must be there."""

    query_id: int
    began: float
    open: dict[Future, tuple[str, float]] = field(default_factory=dict)


def answers(queries: Iterator[tuple[int, list[tuple[str, str | None, int | None]]]], ask: Callable[[str | None, float], Reply], deadline: float, at_once: int = 4, clock: Callable[[], float] = time.monotonic) -> Iterator[tuple[int, str, Reply, float]]:
    """(query, engine, reply, seconds) for each (engine, address, timeout in milliseconds) of each query.

    ``ask`` gets an address and the seconds left.  What answers too late goes on
    in its thread, up to its own timeout, and is not waited for.
    """
    pools: dict[int, ThreadPoolExecutor] = {}
    running: deque[Query] = deque()
    source, done = iter(queries), False
    try:
        while True:
            while not done and len(running) < at_once:
                try:
                    query_id, requests = next(source)
                except StopIteration:
                    done = True
                    break
                q = Query(query_id, clock())
                pools[id(q)] = ThreadPoolExecutor(max(1, len(requests)))
                for engine, url, timeout in requests:
                    left = min(deadline, timeout / 1000 if timeout is not None else deadline)
                    q.open[pools[id(q)].submit(ask, url, left)] = (engine, q.began + left)
                running.append(q)
            if not running:
                return
            soonest = min(t for q in running for _, t in q.open.values()) if any(q.open for q in running) else clock()
            every = [f for q in running for f in q.open]
            if every:
                wait(every, timeout=max(0.0, soonest - clock()), return_when=FIRST_COMPLETED)
            now = clock()
            for q in list(running):
                for f, (engine, until) in list(q.open.items()):
                    if f.done():
                        reply = f.result()
                    elif now >= until:
                        reply = Reply("", TIMED_OUT)
                    else:
                        continue
                    del q.open[f]
                    yield q.query_id, engine, reply, now - q.began
                if not q.open:
                    running.remove(q)
                    pools.pop(id(q)).shutdown(wait=False, cancel_futures=True)
    finally:
        for p in pools.values():
            p.shutdown(wait=False, cancel_futures=True)


def fan_out(requests: DataFrame, deadline: float = 8.0, limits: Limits = Limits(), at_once: int = 4) -> DataFrame:
    """One row of ``SCHEMA`` for each request (query_id, engine, url, timeout_ms); ``error`` is null for a reply.

    The engines of a query are a bounded list, so a query is a small group; its
    rows come together by one shuffle and are read in a stream.
    """
    d = requests.select(F.col("query_id").cast("long").alias("query_id"), "engine", "url", F.col("timeout_ms").cast("int").alias("timeout_ms"))
    d = d.repartition("query_id").sortWithinPartitions("query_id", "engine")

    def ask(url: str | None, left: float) -> Reply:
        return read(url, Limits(**{**limits.__dict__, "seconds": min(limits.seconds, left)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for query_id, engine, reply, seconds in answers(grouped(batches), ask, deadline, at_once):
            error = TIMED_OUT if reply.error_kind == "timeout" else reply.error_kind
            held.append((query_id, engine, reply.status, reply.content_type, reply.body, error, error == "rate_limited", seconds))
            size += len(reply.body or b"")
            if size > 4 << 20 or len(held) >= 1000:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return d.mapInArrow(run, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``SCHEMA``."""
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.bool_(), pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The requests of each query, from batches that are sorted by query."""
    now, own = None, []
    for b in batches:
        for r in b.to_pylist():
            if own and r["query_id"] != now:
                yield now, own
                own = []
            now = r["query_id"]
            own.append((r["engine"], r["url"], r["timeout_ms"]))
    if own:
        yield now, own


def failures(replies: DataFrame) -> DataFrame:
    """Engines that did not answer, as ``fuse.responses`` takes them."""
    return replies.where("error IS NOT NULL").select("query_id", "engine", "error", "is_rate_limited")
