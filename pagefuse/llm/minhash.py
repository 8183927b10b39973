"""MinHash near-dedup with circulant permutations and exact verification.

Two permutations of the 64-bit numbers generate all coordinates: sigma places
a shingle on a circle, and coordinate k is the smallest pi(sigma(x) - k) over
the set, pi shifted circularly by k.  ``bands`` keys of ``rows`` coordinates
each make the buckets; at a similarity of 0.85 (0.8) the chance that a pair
shares none of 16 (24) keys of 4 is below 1e-5 (1e-5).

1. One pass over the texts: set size, a 128-bit fingerprint of the set, band keys.
2. Equal sets become one class, so copies cost nothing further.
3. In every bucket, each class is compared with the bucket's smallest one on
   the full shingle sets.  That joins most classes of a group with one
   comparison each.
4. Buckets that still hold several components are compared pair by pair, in
   blocks, as products of 0/1 matrices; a pair counts in the first band that it
   shares, and a task returns a spanning forest of its links.  So no link between
   components is lost, whatever the size of a bucket, and no bucket is gathered
   in one task.

Edge cases: null and empty texts and texts without words have the empty set and
are linked with nothing; rows with a null id likewise, and are kept; rows that
share an id share a component; a text shorter than a shingle has its whole
word sequence as its only one; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import forest, min_label_components, written

U = np.uint64
SIGMA, PI = U(0x2545F4914F6CDD1D), U(0x632BE59BD9B4E019)
#: Sets that are multiplied with as many at once, and the bytes of sets in a block.
PART, BLOCK_BYTES = 256, 8 << 20


def band_keys(x: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys of sets laid end to end in ``x``, none of them empty; ``at`` has where each begins."""
    placed = ta.mix(x ^ SIGMA)
    out = np.empty((len(at), bands), dtype=U)
    for b in range(bands):
        key = np.full(len(at), (b + 1) * 0x9E3779B97F4A7C15 % (1 << 64), dtype=U)
        for r in range(rows):
            h = ta.mix((placed - U(b * rows + r)) ^ PI)
            key = ta.mix(key * U(ta.FACTORS[3]) + np.minimum.reduceat(h, at))
        out[:, b] = key
    return out


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, sets laid end to end, their offsets), chunk by chunk."""
    values, offsets = ta.string_parts(texts)
    for i, j in ta.chunks(offsets):
        part, off = values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        _, _, h, t = ta.words(part, off, lower=True)
        g, t = ta.shingles(h, t, j - i, n)
        yield i, j, *ta.sets(g, t, j - i)


def fingerprints(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set, none empty, that name it."""
    return np.add.reduceat(ta.mix(x ^ U(ta.FACTORS[4])), at), np.add.reduceat(ta.mix(x ^ U(ta.FACTORS[5])), at)


def signatures(df: DataFrame, shingle: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, f2, bands) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x, off in shingle_sets(b.column("__text"), shingle):
                n = np.diff(off)
                full = np.flatnonzero(n)
                f1, f2 = np.zeros(j - i, U), np.zeros(j - i, U)
                keys = np.zeros((j - i, bands), U)
                if len(full):
                    at = off[:-1][full]
                    f1[full], f2[full] = fingerprints(x, at)
                    keys[full] = band_keys(x, at, bands, rows)
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], names=["id", "n", "f1", "f2", "bands"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text")).mapInArrow(ta.tidy(run), "id long, n long, f1 long, f2 long, bands array<long>")


def full_sets(df: DataFrame, shingle: int) -> DataFrame:
    """(id, f1, items) of each row of (id, __text): the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x, off in shingle_sets(b.column("__text"), shingle):
                f1 = np.zeros(j - i, U)
                full = np.flatnonzero(np.diff(off))
                if len(full):
                    f1[full] = fingerprints(x, off[:-1][full])[0]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(f1.view(np.int64)), ta.binary_array(x, off)], names=["id", "f1", "items"])

    return df.mapInArrow(ta.tidy(run), "id long, f1 long, items binary")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(a) else 0


def intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of all pairs of two short lists of sets.

    Items are the columns of 0/1 matrices, ``width`` at a time, whose product
    counts; items that only one set holds are left out.
    """
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    items = [np.concatenate(x) if x else np.zeros(0, U) for x in (a, b)]
    common = np.intersect1d(items[0], items[1])
    at = [np.minimum(np.searchsorted(common, x), max(len(common) - 1, 0)) for x in items]
    for lo in range(0, len(common), width):
        m = []
        for x, c, r, n in zip(items, at, rows, (len(a), len(b)), strict=True):
            own = np.flatnonzero((c >= lo) & (c < lo + width) & (common[c] == x))
            d = np.zeros((n, min(width, len(common) - lo)), dtype=np.float32)
            d[r[own], c[own] - lo] = 1
            m.append(d)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def joined(label: np.ndarray, links: list[tuple[int, int]]) -> np.ndarray:
    """Labels after the links between labels."""
    if not links:
        return label
    to = np.arange(int(label.max()) + 1)
    for u, v in links:
        while to[u] != u:
            u = to[u]
        while to[v] != v:
            v = to[v]
        to[max(u, v)] = min(u, v)
    while (to[to] != to).any():
        to = to[to]
    return to[label]


def linked(n: int, m: int, both: int, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    return 100 * both >= percent * (n + m - both)


def verify(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, fa, b, fb) that are links on the full sets, as edges (a, b)."""
    left = items.select(F.col("id").alias("a"), F.col("f1").alias("fa"), F.col("items").alias("x"))
    right = items.select(F.col("id").alias("b"), F.col("f1").alias("fb"), F.col("items").alias("y"))
    both = pairs.join(left, ["a", "fa"]).join(right, ["b", "fb"]).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(xs[i].as_buffer(), U), np.frombuffer(ys[i].as_buffer(), U)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    ok[i] = linked(len(x), len(y), overlap(x, y), percent)
            keep = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

    return both.mapInArrow(ta.tidy(run), "a long, b long")


#: Pairs of blocks that a cell compares, on average.
CELL_PAIRS = 32


def block_pairs(buckets: DataFrame) -> int:
    """Pairs of blocks of all buckets (``blocks``)."""
    n = F.col("blocks").cast("double")
    return int(buckets.agg(F.sum(n * (n + 1) / 2)).first()[0] or 0)


def residual_links(rows: DataFrame, items: DataFrame, percent: int, pairs_in_all: int = 0) -> DataFrame:
    """Edges between components within a bucket, by pairs of blocks; ``rows``: (band, key, hub, blocks, id, f1, comp).

    Pairs of blocks are dealt to cells by the bucket's smallest class, which the
    buckets of a group share from band to band, so a cell gets the set of a class
    once for all of them.  There are cells enough that each gets ``CELL_PAIRS``
    of the ``pairs_in_all`` on average at most, whatever the table's size or
    settings.  ``items`` has (id, f1, bands, items).
    """
    own = F.pmod(F.xxhash64("id", "f1"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi")))
    cells = max(16 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs_in_all // CELL_PAIRS))
    tasks = rows.select("band", "key", "hub", "id", "f1", "comp", own.alias("own"), F.explode(pairs).alias("t")).select("*", "t.lo", "t.hi").drop("t")
    tasks = tasks.withColumn("cell", F.pmod(F.xxhash64("hub", "lo", "hi"), F.lit(cells))).drop("hub")
    wanted = tasks.select(F.col("cell").alias("at"), F.col("id").alias("a"), F.col("f1").alias("fa")).distinct()
    sets = wanted.join(items, (F.col("a") == F.col("id")) & (F.col("fa") == F.col("f1"))).select("at", "a", "fa", "bands", "items")

    def of_cell(todo: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        at = {k: i for i, k in enumerate(zip(sets["a"], sets["fa"], strict=True))}
        have = [np.frombuffer(x, U) for x in sets["items"]]
        keys = np.array(sets["bands"].tolist(), dtype=np.int64)
        out = [np.zeros((0, 2), dtype=np.int64)]
        for (band, _, lo, hi), g in todo.groupby(["band", "key", "lo", "hi"], sort=False):
            where = np.array([at[k] for k in zip(g["id"], g["f1"], strict=True)])
            out.append(compare(int(band), [have[i] for i in where], keys[where], g["id"].to_numpy(), g["comp"].to_numpy(), g["own"].to_numpy(), int(lo), int(hi)))
        found = np.concatenate(out)
        del at, have, keys
        ta.give_back()
        return pd.DataFrame(forest(found[:, 0], found[:, 1]), columns=["a", "b"], dtype="int64")

    def compare(band: int, sets: list[np.ndarray], keys: np.ndarray, ids: np.ndarray, comp: np.ndarray, side: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Links between two blocks of a bucket, ``PART`` sets with as many at once."""
        size = np.array([len(x) for x in sets], dtype=np.int64)
        comp, found = np.unique(comp, return_inverse=True)[1], []
        order = np.argsort(comp, kind="stable")  # parts of one component need no comparison with themselves
        first, second = order[side[order] == lo], order[side[order] == hi]
        for i in range(0, len(first), PART):
            for j in range(i if lo == hi else 0, len(second), PART):
                x, y = first[i : i + PART], second[j : j + PART]
                ok = comp[x][:, None] != comp[y][None, :]
                ok &= 100 * np.minimum(size[x][:, None], size[y][None, :]) >= percent * np.maximum(size[x][:, None], size[y][None, :])
                for b in range(band):  # the first band that two share must be this one, or another task compares them
                    ok &= keys[x, b][:, None] != keys[y, b][None, :]
                x, y, ok = x[ok.any(axis=1)], y[ok.any(axis=0)], ok[ok.any(axis=1)][:, ok.any(axis=0)]
                if not ok.size:
                    continue
                both = intersections([sets[k] for k in x], [sets[k] for k in y])
                ok &= 100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)
                p, q = np.nonzero(ok)
                comp = joined(comp, forest(comp[x[p]], comp[y[q]]))
                found.append(np.stack([ids[x[p]], ids[y[q]]], axis=1))
        return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)

    return tasks.groupBy("cell").cogroup(sets.groupBy("at")).applyInPandas(of_cell, "a long, b long")


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, block: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept``.

    A bucket's blocks have ``block`` classes or ``BLOCK_BYTES`` of sets at most.
    """
    sig = written(signatures(df, shingle, bands, rows, id_col, text_col))
    full = sig.where("n > 0 AND id IS NOT NULL")
    reps = full.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    reps = written(reps.select("id", "f1", "f2", "n", "bands"))
    keyed = reps.select("id", "f1", "n", F.posexplode("bands").alias("band", "key"))
    hubs = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "f1")).alias("hub")).where("c > 1").select("band", "key", "hub")
    live = written(keyed.join(hubs, ["band", "key"]))
    wanted = live.select("id", "f1").distinct()
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text")).join(wanted.select("id").distinct(), "id", "left_semi")
    items = written(full_sets(texts, shingle).join(wanted, ["id", "f1"], "left_semi").dropDuplicates(["id", "f1"]))
    star = live.where("id <> hub.id OR f1 <> hub.f1").select(F.col("id").alias("a"), F.col("f1").alias("fa"), F.col("hub.id").alias("b"), F.col("hub.f1").alias("fb")).distinct()
    edges = written(verify(star, items, percent))
    comp = min_label_components(edges)
    placed = live.select("band", "key", F.col("hub.id").alias("hub"), "id", "f1", "n").join(comp, F.col("id") == F.col("node"), "left").select("band", "key", "hub", "id", "f1", "n", F.coalesce("component", "id").alias("comp"))
    # buckets with several components, as a table: its size decides how it is joined, and Spark can split a large bucket
    open_ = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    open_ = written(open_.select("band", "key", F.ceil(F.greatest(F.col("c") / block, 8 * F.col("n") / BLOCK_BYTES)).cast("int").alias("blocks")))
    rest = placed.drop("n").join(open_, ["band", "key"])
    more = written(residual_links(rest, items.join(reps.select("id", "f1", "bands"), ["id", "f1"]), percent, block_pairs(open_)))
    if not more.isEmpty():
        comp = min_label_components(edges.union(more))
    of_rep = reps.select("f1", "f2", F.col("id").alias("rep")).join(comp, F.col("rep") == F.col("node"), "left")
    of_rep = of_rep.select(F.col("f1").alias("__1"), F.col("f2").alias("__2"), F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("id", "n", "f1", "f2").join(of_rep, (F.col("f1") == F.col("__1")) & (F.col("f2") == F.col("__2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    c = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), c.alias("component_id"), F.coalesce(c == F.col("id"), F.lit(True)).alias("kept"))


def numbered(df: DataFrame, id_col: str, out: str) -> DataFrame:
    """``df``, written, with a number for each row that has an id, in order of the ids."""
    d = df.repartitionByRange(id_col).sortWithinPartitions(id_col)
    return written(d.withColumn(out, F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """Rows of ``df`` whose document stays: one for each group of near copies, columns unchanged.

    Where an id has several rows, each is a document of its own: only those that
    are copies go, and of equal texts one stays.  Rows whose text has no words,
    and rows without an id, are copies of nothing.
    """
    names = df.columns
    several = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    key = id_col
    if not several.isEmpty():
        df, key = numbered(df, id_col, "__row"), "__row"
    found = near_duplicates(df, id_col=key, text_col=text_col, **options)
    gone = found.where(~F.col("kept")).select(F.col(key).alias("__gone")).distinct()
    return df.join(gone, F.col(key) == F.col("__gone"), "left_anti").select(*names)
