"""Packing into optimal length buckets and token-budget batches.

Lengths are counted once and kept in a table.  ``encoded`` has the tokens of
the tokenizer of ``token_counts``, which the query and the pipeline pack; without
it ``packed`` counts pre-tokens natively, where a run of letters is one however
long, so that budget is one of words.  The lengths' global histogram (bounded: lengths up to
``max_tokens``) goes to the driver, where dynamic
programming finds the ``n_buckets`` upper edges with the least padding in
total.  Each piece goes to the smallest edge that holds it, and batches of
``budget // edge`` pieces form inside each bucket.

Documents longer than ``max_tokens`` are cut into pieces of that length and a
rest, so whole texts are packed.

Edge cases: a null or empty text has only its end token, length 1; repeated
rows and null ids are pieces like any other; an empty table gives no rows; ties
in the order are broken by the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, written
from .token_counts import load

#: Pre-tokens: words, single digits, and other visible characters one by one.
PIECES = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]"


def token_length(text: Column) -> Column:
    """Pre-tokens of a text and one end token."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PIECES)) + 1).cast("long")


def encoded(df: DataFrame, text_col: str = "text", out: str = "n_tokens", tokenizer_path: str | None = None) -> DataFrame:
    """``df`` with the tokens of its text and one end token in place of the text; each text is encoded whole."""
    keep = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = load(tokenizer_path)
        for b in batches:
            n = [len(enc.encode_ordinary(t.as_py() or "")) + 1 for t in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n, pa.int64())], names=[*keep, out])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in keep], f"`{out}` long"]))


def optimal_edges(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper edges, at most ``n_buckets`` and the largest length last, with the least total padding.

    best[k][j] is the least padding of the first j lengths in k buckets; the
    cost of a bucket follows from prefix sums, in whole numbers.
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths)[order].astype(np.int64), np.asarray(counts)[order].astype(np.int64)
    m = len(x)
    if not m:
        return []
    n, s = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    best = x * n[1:] - s[1:]
    back = [np.zeros(m, dtype=np.int64)]
    for _ in range(1, min(n_buckets, m)):
        new, arg = best.copy(), np.full(m, -1, dtype=np.int64)
        for j in range(1, m):
            i = np.arange(j)  # the bucket before ends at length i
            cost = best[:j] + x[j] * (n[j + 1] - n[i + 1]) - (s[j + 1] - s[i + 1])
            k = int(cost.argmin())
            if cost[k] < new[j]:
                new[j], arg[j] = cost[k], k
        best = new
        back.append(arg)
    edges, j, k = [int(x[-1])], m - 1, len(back) - 1
    while k > 0:
        i = int(back[k][j])
        if i >= 0:
            edges.append(int(x[i]))
            j = i
        k -= 1
    return sorted(set(edges))


def histogram(lengths: DataFrame, length_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and how many pieces have them."""
    rows = lengths.groupBy(F.col(length_col).alias("len")).agg(F.count(F.lit(1)).alias("n")).collect()
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def pieces_of(df: DataFrame, max_tokens: int, text_col: str, keep: list[str], length: Column | None = None) -> DataFrame:
    """Pieces of at most ``max_tokens`` of each document, with their first token."""
    n = token_length(F.col(text_col)) if length is None else length
    d = df.select(*[F.col(c) for c in keep], n.alias("__len"))
    d = d.select(*keep, "__len", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__len") - 1) / max_tokens).cast("long"))).alias("piece"))
    return d.select(*keep, "piece", (F.col("piece") * max_tokens).alias("start_token"), F.least(F.lit(max_tokens).cast("long"), F.col("__len") - F.col("piece") * max_tokens).alias("n_tokens"))


def packed(df: DataFrame, max_tokens: int = 4096, budget: int = 65536, n_buckets: int = 16, id_col: str = "doc_id", text_col: str = "text", order: str | None = None, length_col: str | None = None) -> DataFrame:
    """One row for each piece: its bucket (``bucket_len``), batch in the bucket, slot in the batch and padding.

    ``order`` names a column of whole numbers, without long runs of one: pieces
    fill the batches in its order, rows being numbered within ranges of it.
    Without it they come in order of a hash of the id.
    ``length_col`` names a column with the tokens of a row, end token included,
    as ``encoded`` gives them; the text is not read then.
    """
    if budget < max_tokens:
        raise ValueError("budget must hold max_tokens")
    n = F.col(length_col).cast("long") if length_col else token_length(F.col(text_col))
    d = df.select(F.col(id_col), n.alias("__n"), *([F.shiftright(F.col(order).cast("long"), 12).alias("__sub"), F.col(order).cast("long").alias("__ord")] if order else []))
    if not order:
        h = F.xxhash64(F.col(id_col))
        d = d.withColumn("__sub", F.shiftrightunsigned(h, 54)).withColumn("__ord", h)
    p = pieces_of(written(d), max_tokens, text_col, [id_col, "__sub", "__ord"], F.col("__n"))
    edges = optimal_edges(*histogram(p, "n_tokens"), n_buckets) or [max_tokens]
    edge = F.element_at(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda e: e >= F.col("n_tokens")), 1)
    p = p.withColumn("bucket_len", edge)
    q = gapless(p, ["bucket_len"], "__sub", ["__ord", "piece", "n_tokens"], "__idx")
    per = F.floor(F.lit(budget) / F.col("bucket_len")).cast("long")
    return q.select(
        id_col,
        "piece",
        "start_token",
        "n_tokens",
        "bucket_len",
        F.floor(F.col("__idx") / per).cast("long").alias("batch"),
        (F.col("__idx") % per).cast("long").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
