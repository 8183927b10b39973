"""Embedding near-dedup by a pivot-permutation index.

Vectors of one length are an index of their own.

1. Pivots: reference vectors out of a bounded sample, no two of them closer than
   ``APART``.  So a dense group has one pivot at most inside it, and its members
   see the other pivots from nearly the same place.  Their number grows with the
   square root of the number of vectors, so the inverted lists do too.
2. Each vector is described by its ``near`` nearest pivots in order, nearest first.
3. Inverted lists: a vector goes to the lists of its pivots.  Two vectors are
   candidates when the pivots they share score ``least`` or more; a shared pivot
   counts ``near``, less one for each place that its ranks differ.  Such a pair
   shares ``ceil(least / near)`` pivots at least, so only the first
   ``near - ceil(least / near) + 1`` of a vector's pivots in a fixed order need
   its copy, and the list of the first pivot that a pair shares compares it.
4. Candidates are verified by their cosine: products in single precision, and in
   double precision where single can't tell.

Lists are cut into blocks of ``block`` vectors and each pair of blocks is a task,
so no list is gathered whole and none is capped.  No pair leaves its task: tasks
return link counts and a spanning forest.  Equal vectors are one class before
anything is compared, so copies cost nothing.

The index is approximate: a pair right at the threshold is found with a chance
of 0.99 or more up to some millions of vectors, closer pairs with more; tests
measure it against brute force.  Where few pivots are ``APART`` (all vectors in
a narrow cone), lists are longer and the search comes closer to brute force.

Edge cases: null, zero or empty vectors and vectors with null or non-finite
components link with nothing; vectors of different lengths don't link; repeated
rows with one id are classes by their vector, and each row
is returned; a null id is never a class's smallest id; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forest, min_label_components, written

#: The largest cosine of two pivots, and the vectors that are scored against a block at once.
APART, TILE = 0.6, 1024


def usable(vec: Column) -> Column:
    """True for a vector that can have a cosine with another."""
    x = F.coalesce(vec, F.array().cast("array<double>"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return finite & F.exists(x, lambda v: v != 0)


def classes_of(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): the vector where it is usable, else null; floats stay floats."""
    v = F.col(vec_col)
    if df.schema[vec_col].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    return df.select(F.col(id_col).alias("vec_id"), F.when(usable(v), v).alias("v"))


def pick_pivots(reps: DataFrame, pivots: int, near: int) -> np.ndarray:
    """At most ``pivots`` unit vectors, no two with a cosine over ``APART``, rarely near ones first.

    They come from a sample of four times as many classes of one length, first
    by hash of the class id.
    """
    rows = reps.orderBy(F.xxhash64("cls"), "cls").limit(4 * pivots).select("v").collect()
    x = unit(np.array([r[0] for r in rows], dtype=np.float64))
    free, own = np.ones(len(x), dtype=bool), []
    for i in range(len(x)):
        if free[i] and len(own) < pivots:
            own.append(i)
            free &= x @ x[i] <= APART
    p = x[own]
    often = np.bincount(permutations(x, p, near).ravel(), minlength=len(p))
    return p[np.argsort(often, kind="stable")]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row is scaled by its largest component first, so squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def permutations(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The ``near`` nearest pivots of each unit vector, nearest first; ties by pivot number."""
    s = x @ pivots.T
    return np.argsort(-s, axis=1, kind="stable")[:, :near].astype(np.int32)


def scores(perm: np.ndarray, a: np.ndarray, b: np.ndarray, pivot: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Shared-pivot scores of all pairs of ``a`` and ``b``, and which pairs share a pivot before ``pivot``."""
    score, early = np.zeros((len(a), len(b)), dtype=np.int16), np.zeros((len(a), len(b)), dtype=bool)
    lists = []
    for own in (a, b):
        flat = perm[own].ravel()
        order = np.argsort(flat, kind="stable")
        name, at = np.unique(flat[order], return_index=True)
        lists.append((dict(zip(name.tolist(), range(len(name)), strict=True)), np.split(order, at[1:])))
    (in_a, la), (in_b, lb) = lists
    width = perm.shape[1]
    for q in sorted(in_a.keys() & in_b.keys()):
        i, j = la[in_a[q]], lb[in_b[q]]
        pairs = np.ix_(i // width, j // width)
        if q < pivot:
            early[pairs] = True
            if early.all():  # other lists have every pair
                break
        else:
            score[pairs] += (near - np.abs((i % width)[:, None] - (j % width)[None, :])).astype(np.int16)
    return score, early


def join_lists(x: np.ndarray, perm: np.ndarray, copies: np.ndarray, first: np.ndarray, second: np.ndarray | None, pivot: int, threshold: float, near: int, least: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row, weighted by copies, and a spanning forest, over the candidates of a pivot's list.

    The pairs are those of ``first`` with ``second``, or within ``first``.
    """
    n, label, edges = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), []
    single = x.astype(np.float32)
    slack = (x.shape[1] + 4) * 2.0**-23  # over the rounding error of a product in single precision
    for lo in range(0, len(first), TILE):
        a = first[lo : lo + TILE]
        b = first[lo:] if second is None else second
        score, early = scores(perm, a, b, pivot, near)
        hit = (score >= least) & ~early
        if second is None:
            hit &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
        if not hit.any():
            continue
        if np.count_nonzero(hit) * 50 > hit.size:
            c = single[a] @ single[b].T
            hit &= c >= np.float32(threshold - slack)
            i, j = np.nonzero(hit & (c <= np.float32(threshold + slack)))  # too close to call
        else:
            i, j = np.nonzero(hit)
        for k in range(0, len(i), 1 << 16):
            ii, jj = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            hit[ii, jj] = np.einsum("ij,ij->i", x[a[ii]], x[b[jj]]) >= threshold
        n[a] += hit @ copies[b]
        n[b] += copies[a] @ hit
        while True:  # each round joins every component that has an open link
            open_ = hit & (label[a][:, None] != label[b][None, :])
            i = np.flatnonzero(open_.any(axis=1))
            if not len(i):
                break
            found = forest(label[a[i]], label[b[open_[i].argmax(axis=1)]])
            edges += found  # labels are rows of their components
            for u, v in found:
                while label[u] != u:
                    u = label[u]
                while label[v] != v:
                    v = label[v]
                label[max(u, v)] = min(u, v)
            while (label[label] != label).any():
                label = label[label]
    return n, edges


def near_duplicates(df: DataFrame, threshold: float = 0.95, pivots: int | None = None, near: int = 8, least: int = 12, block: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each vector: ``n_links``, ``component_id`` (smallest id reachable by links) and ``kept``.

    ``pivots`` is the most of them for each vector length; by default half the
    square root of its number of different vectors, 128 at least.
    """
    rows = classes_of(df, id_col, vec_col)
    reps = rows.where("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("copies"))
    reps = written(reps)
    sizes = {r[0]: r[1] for r in reps.groupBy(F.size("v")).count().collect()}
    drawn = {size: pick_pivots(reps.where(F.size("v") == size), pivots or max(128, int(n**0.5 / 2)), near) for size, n in sizes.items()}
    sent = df.sparkSession.sparkContext.broadcast(drawn)  # half the square root of the vectors: 16,000 for a billion
    prefix = near - -(-least // near) + 1

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("v")
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            begin = np.cumsum(lengths) - lengths
            for size in np.unique(lengths).tolist():
                ok = np.flatnonzero(lengths == size)
                v = flat[begin[ok][:, None] + np.arange(size)]
                p = sent.value[size]
                perm = permutations(unit(v.astype(np.float64)), p, near)
                few = np.sort(perm, axis=1)[:, : prefix if perm.shape[1] == near else 1]  # of fewer pivots, all share the first
                flat_few = pa.ListArray.from_arrays(pa.array(np.arange(len(ok) + 1, dtype=np.int32) * few.shape[1]), pa.array(few.ravel(), pa.int32()))
                own = pa.array(ok)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size] * len(ok), pa.int32()), b.column("cls").take(own), b.column("copies").take(own), pa.array([r.tobytes() for r in v], pa.binary()), pa.array([r.tobytes() for r in perm], pa.binary()), flat_few],
                    names=["size", "cls", "copies", "x", "perm", "lists"],
                )

    listed = written(reps.mapInArrow(describe, "size int, cls long, copies long, x binary, perm binary, lists array<int>"))
    lists = listed.select("*", F.explode("lists").alias("pivot")).drop("lists")
    # a row for each list: at most the pivots
    lengths = lists.groupBy("size", "pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cls", "pivot"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi")))
    tasks = lists.join(F.broadcast(lengths), ["size", "pivot"]).select("size", "pivot", "cls", "copies", "x", "perm", own.alias("own"), F.explode(pairs).alias("t")).select("*", "t.lo", "t.hi").drop("t")

    def join_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size, pivot, lo, hi = (int(k) for k in key)
        raw = b"".join(pdf["x"])
        kind = np.float32 if len(raw) == 4 * size * len(pdf) else np.float64
        x = unit(np.frombuffer(raw, dtype=kind).reshape(len(pdf), -1).astype(np.float64))
        perm = np.frombuffer(b"".join(pdf["perm"]), dtype=np.int32).reshape(len(pdf), -1)
        cls, copies, side = pdf["cls"].to_numpy(), pdf["copies"].to_numpy(), pdf["own"].to_numpy()
        # fewer pivots than places: every vector has all of them, and is a candidate of every other
        score = least if perm.shape[1] == near else 1
        n, edges = join_lists(x, perm, copies, np.flatnonzero(side == lo), None if lo == hi else np.flatnonzero(side == hi), pivot, threshold, near, score)
        some = np.flatnonzero(n)
        return pd.DataFrame({"a": [*cls[some], *[cls[e[0]] for e in edges]], "b": [*cls[some], *[cls[e[1]] for e in edges]], "n": [*n[some], *[0] * len(edges)]}, dtype="int64")

    found = written(tasks.groupBy("size", "pivot", "lo", "hi").applyInPandas(join_blocks, "a long, b long, n long"))
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("linked")).select(F.col("a").alias("__c"), "linked")
    comp = min_label_components(found.where("a <> b"))
    of_class = reps.join(counts, F.col("cls") == F.col("__c"), "left").join(comp, F.col("cls") == F.col("node"), "left")
    of_class = of_class.select(F.col("v").alias("__v"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    out = rows.join(of_class, (F.col("v") == F.col("__v")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
