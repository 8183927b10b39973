"""Sliding-window admission as a min-plus recurrence, worked out over stretches of time in parallel.

A limiter that counts admitted calls lets one through if fewer than ``limit``
admitted calls lie in the ``seconds`` before it.  With n(t) calls in second t,
the calls admitted up to t are

    C(t) = min(C(t - 1) + n(t), C(t - seconds - 1) + limit)

which is linear in the algebra of minimum and plus.  So what a stretch of time
does to the last ``seconds + 1`` values of C is a matrix, whatever they are:
stretches are worked out at once, each for every unit vector; a fold over the
small matrices of a key gives the values before each stretch; and a second pass
over the stretches gives C.  Within ``seconds + 1`` steps no value depends on
another's second term, so numpy does that many at once.

A stretch that no call precedes within the window starts anew and needs no
matrix.  Matrices have ``(seconds + 1) ** 2`` numbers for each stretch of
``stretch`` seconds that has calls just before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stands for infinity: sums of two stay within 64 bits.
FAR = np.int64(1) << np.int64(60)
#: Seconds of a stretch, at least.
STRETCH = 1 << 15
#: Groups into which the calls of one key and second are dealt before they are ranked.
DEALT = 64
ROWS = "key binary, stretch long, ts long, n long, start binary"


def admitted_up_to(at: np.ndarray, n: np.ndarray, start: np.ndarray, limit: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(C at the seconds ``at``, the last values of C) of a stretch of ``length`` seconds, whole blocks, with ``n`` calls at ``at``.

    ``start`` has the ``seconds + 1`` values of C before the stretch, oldest
    first, in each of its columns; the results have as many columns.
    """
    w = len(start)
    out = np.empty((len(at), start.shape[1]), dtype=np.int64)
    block, last = at // w, start
    cuts = np.flatnonzero(np.diff(block, prepend=-2))
    done = -1
    for a, b in zip(cuts.tolist(), [*cuts.tolist()[1:], len(at)], strict=False):
        k = int(block[a])
        last = idle(last, k - 1 - done, limit)
        calls = np.zeros(w, dtype=np.int64)
        calls[at[a:b] - k * w] = n[a:b]
        up = np.cumsum(calls)[:, None]
        last = np.minimum(up + np.minimum(np.minimum.accumulate(last + limit - up, axis=0), last[-1]), FAR)
        out[a:b] = last[at[a:b] - k * w]
        done = k
    return out, idle(last, length // w - 1 - done, limit)


def idle(last: np.ndarray, blocks: int, limit: int) -> np.ndarray:
    """``last`` after blocks without calls; after two of them nothing changes any more."""
    for _ in range(min(max(blocks, 0), 2)):
        last = np.minimum(np.minimum(np.minimum.accumulate(last + limit, axis=0), last[-1]), FAR)
    return last


def unit(w: int) -> np.ndarray:
    """The unit matrix of the algebra."""
    out = np.full((w, w), FAR, dtype=np.int64)
    np.fill_diagonal(out, 0)
    return out


def through(matrix: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The values after a stretch whose matrix is given."""
    return np.minimum((matrix + start[None, :]).min(axis=1), FAR)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes | None, int, np.ndarray, np.ndarray, bytes | None]]:
    """(key, stretch, seconds, calls, start values) of rows that are sorted by key, stretch and second; rows that carry start values come first."""
    held: list[pa.RecordBatch] = []

    def flush(t: pa.Table) -> Iterator[tuple]:
        key, stretch = t.column("key").to_pylist(), t.column("stretch").to_numpy()
        ts, n, start = t.column("ts").to_numpy(), t.column("n").to_numpy(), t.column("start").to_pylist()
        cuts = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1] or stretch[i] != stretch[i - 1]]
        for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
            first = a + (start[a] is not None)
            yield key[a], int(stretch[a]), ts[first:b], n[first:b], start[a]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        # the last group may go on in the next batch
        key, stretch, end = batch.column("key").to_pylist(), batch.column("stretch").to_pylist(), batch.num_rows
        while end and key[end - 1] == key[-1] and stretch[end - 1] == stretch[-1]:
            end -= 1
        if end:
            held[-1] = batch.slice(0, end)
            yield from flush(pa.Table.from_batches(held))
            held = [batch.slice(end)]
    if held:
        yield from flush(pa.Table.from_batches(held))


def per_second(counts: DataFrame, limit: int, seconds: int, stretch: int | None = None) -> DataFrame:
    """``key``, ``ts`` and ``admitted``, the calls that are let through in each second, from one row (``key`` binary, ``ts``, ``n``) for each second with calls.

    Longer windows have longer stretches, so that a key's matrices stay below the size of its seconds.
    """
    w = seconds + 1
    length = -(-(stretch or max(STRETCH, 4 * w * w)) // w) * w  # whole blocks
    d = counts.select("key", F.floor(F.col("ts") / length).cast("long").alias("stretch"), "ts", F.col("n").cast("long").alias("n"))
    # stretches that follow another with calls in its last ``seconds``
    spans = d.groupBy("key", "stretch").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    order = Window.partitionBy("key").orderBy("stretch")
    follows = F.coalesce((F.lag("stretch").over(order) == F.col("stretch") - 1) & (F.lag("b").over(order) >= F.col("a") - seconds), F.lit(False))
    spans = spans.withColumn("follows", follows)
    spans = spans.withColumn("chain", F.sum((~F.col("follows")).cast("long")).over(order))
    spans = spans.withColumn("links", F.count(F.lit(1)).over(Window.partitionBy("key", "chain"))).where("links > 1").select("key", "stretch", "chain", "follows")
    s = spans.select(F.col("key").alias("__k"), F.col("stretch").alias("__s"), "chain", "follows")
    linked = d.join(s, F.col("key").eqNullSafe(F.col("__k")) & (F.col("stretch") == F.col("__s")))
    small = "key binary, stretch long, chain long, follows boolean, matrix binary"

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, k, at, n, head in groups_of(batches):
            chain, follows = int(head[1:].decode()), head[:1] == b"1"
            start = unit(w) if follows else np.zeros((w, 1), dtype=np.int64)
            _, last = admitted_up_to(at - k * length, n, start, limit, length)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([k]), pa.array([chain]), pa.array([follows]), pa.array([last.tobytes()], pa.binary())], names=["key", "stretch", "chain", "follows", "matrix"])

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by("stretch")
        out, now = [], np.zeros(w, dtype=np.int64)
        for follows, blob in zip(group.column("follows").to_pylist(), group.column("matrix").to_pylist(), strict=True):
            out.append(now.tobytes() if follows else None)
            own = np.frombuffer(blob, dtype=np.int64).reshape(w, -1)
            now = through(own, now) if follows else own[:, 0]
            now = now - now[-1]  # only differences matter
        return pa.table({"key": group.column("key"), "stretch": group.column("stretch"), "start": pa.array(out, pa.binary())})

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, k, at, n, head in groups_of(batches):
            start = (np.frombuffer(head, dtype=np.int64) if head else np.zeros(w, dtype=np.int64))[:, None]
            up, _ = admitted_up_to(at - k * length, n, start, limit, length)
            # C does not change in seconds without calls
            own = np.diff(up[:, 0], prepend=start[-1, 0])
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.binary()), pa.array(at), pa.array(own)], names=["key", "ts", "admitted"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "stretch").sortWithinPartitions("key", "stretch", F.col("start").isNull(), "ts")

    marks = spans.select("key", "stretch", F.lit(0).cast("long").alias("ts"), F.lit(0).cast("long").alias("n"), F.concat(F.col("follows").cast("int").cast("string"), F.col("chain").cast("string")).cast("binary").alias("start"))
    rows = linked.select("key", "stretch", "ts", "n", F.lit(None).cast("binary").alias("start")).unionByName(marks)
    starts = dealt(rows).mapInArrow(matrices, small).groupBy("key", "chain").applyInArrow(fold, "key binary, stretch long, start binary").where("start IS NOT NULL")
    starts = starts.select("key", "stretch", F.lit(0).cast("long").alias("ts"), F.lit(0).cast("long").alias("n"), "start")
    every = d.withColumn("start", F.lit(None).cast("binary")).unionByName(starts)
    return dealt(every).mapInArrow(solved, "key binary, ts long, admitted long")


def admitted(calls: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int, stretch: int | None = None) -> DataFrame:
    """``key``, ``ts``, ``id`` and ``admitted`` of each call; calls of one second go by ``order``, those without a time are not admitted.

    A key with all calls is spread over its seconds, one second with all of
    them over ``DEALT`` groups, whose first ``limit`` calls only are ranked again.
    """
    d = calls.select(F.col(key).alias("key"), F.col(ts).cast("long").alias("ts"), F.col(order).alias("id"))
    as_bytes = F.col("key").cast("string").cast("binary")
    counts = d.where("ts IS NOT NULL").groupBy(as_bytes.alias("key"), "ts").agg(F.count(F.lit(1)).alias("n"))
    let = per_second(counts, limit, seconds, stretch).select(F.col("key").alias("__k"), F.col("ts").alias("__t"), F.col("admitted").alias("__n"))
    d = d.withColumn("__deal", F.pmod(F.xxhash64("id"), F.lit(DEALT)))
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy("key", "ts", "__deal").orderBy("id")))
    no = F.lit(False)
    first = d.where((F.col("__r") <= limit) & F.col("ts").isNotNull())
    first = first.withColumn("__r", F.row_number().over(Window.partitionBy("key", "ts").orderBy("id")))
    same: Column = as_bytes.eqNullSafe(F.col("__k")) & (F.col("ts") == F.col("__t"))
    first = first.join(let, same, "left").select("key", "ts", "id", F.coalesce(F.col("__r") <= F.col("__n"), no).alias("admitted"))
    rest = d.where((F.col("__r") > limit) | F.col("ts").isNull()).select("key", "ts", "id", no.alias("admitted"))
    return first.unionByName(rest)
