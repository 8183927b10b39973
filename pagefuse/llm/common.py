"""Helpers that the operators of this folder share.

All of them are lazy DataFrame transformations unless they say otherwise.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word rule: space and the five control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that any of Spark's file systems may serve."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, below the shared checkpoint folder that the cluster names.

    The setting is read from the session.  Where it is unset, a session of one
    node (tests) takes a folder below the warehouse directory; a cluster has no
    folder that all its nodes are known to share, so that is an error.  The
    folder goes when the driver ends.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/pagefuse-{sc.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return root


def clear_scratch(spark: SparkSession, path: str | None = None) -> None:
    """Delete one of the application's intermediate tables, or all; results that still read them can't be read again."""
    gone = spark._jvm.org.apache.hadoop.fs.Path(path or scratch_root(spark))
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    """A folder for one intermediate table."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def gapless(df: DataFrame, keys: list[str], sub: str, order: list, out: str) -> DataFrame:
    """Number the rows of each group of ``keys`` from 0 without gaps, in order of ``sub``, then ``order``.

    A group is never gathered in one task: rows are numbered within
    (``keys``, ``sub``), and the numbers are shifted by the sizes of the
    earlier ``sub`` groups.  ``sub`` must split a group finely enough; the sizes
    are one row for each (``keys``, ``sub``).  The join with them reuses the
    partitioning of the window, so it adds no shuffle of the rows; for that the
    keys are compared plainly, and none of them may be null.
    """
    n, off = f"__n_{out}", f"__off_{out}"
    before = Window.partitionBy(*keys).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys, sub).agg(F.count(F.lit(1)).alias(n))
    offsets = sizes.select(*keys, sub, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    offsets = offsets.select(*[F.col(c).alias(f"__k_{c}") for c in [*keys, sub]], off)
    numbered = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys, sub).orderBy(*order)))
    same = None
    for c in [*keys, sub]:
        test = F.col(c) == F.col(f"__k_{c}")
        same = test if same is None else same & test
    joined = numbered.join(offsets, same, "left")
    return joined.select(*[F.col(c) for c in df.columns], (F.col(out) - 1 + F.col(off)).alias(out))


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links, by union and find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[p] = q
            out.append((x, y))
    return out


def min_label_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: one row (``node``, ``component``) for each node of an edge.

    ``component`` is the smallest node reachable.  Alternating large-star and
    small-star steps keep the number of edges from growing and end after about
    log(n) rounds; each round is a written table in the shared folder, so a lost
    executor costs one round at most, and the table before it is deleted.  Both steps group by node with partial
    aggregates only (a minimum), never with a list of neighbours.
    """
    spark = edges.sparkSession
    path = new_path(spark)
    cur = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), path)

    def mark(df: DataFrame) -> tuple[int, int]:
        """Edges and a sum over them that changes whenever an edge does."""
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        return (r[0], int(r[1] or 0))

    seen = mark(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.col("v").alias("x"), "m").where("x <> m")
        nxt = small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
        last, path = path, new_path(spark)
        cur = written(nxt.distinct(), path)
        clear_scratch(spark, last)
        now = mark(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
