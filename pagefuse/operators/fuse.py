"""Reciprocal rank fusion: ranked hits of several engines become one ranking for each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.urls import canonical_url

#: Ranks count from this on: a hit at rank r adds weight / (K + r).
K = 60


def hit_key(url: Column, title: Column) -> Column:
    """What makes two hits one: the canonical URL, or the title where there is none."""
    return F.coalesce(canonical_url(url), F.concat(F.lit("nourl:"), F.coalesce(title, F.lit(""))))


def fuse(hits: DataFrame, weights: dict[str, float] | None = None, limit: int | None = 10, key: Column | None = None) -> DataFrame:
    """One row for each kept page of each query, with ``rn`` from 1.

    ``hits``: query_id, engine, engine_ord, rank (from 1 within the engine's
    reply), title, url, snippet, and any other columns.  A page's score is the
    sum over its hits, added in the order (engine_ord, rank) so that rounding is
    the same in every run, and rounded to two decimals before sorting.  Title
    and snippet are the longest in bytes, the first seen of equals; all other
    columns come from the hit seen first.  Ties in score keep the order seen.

    One shuffle by (query, page) with partial aggregates, one by query for the
    ranking, which keeps ``limit`` rows of each before it sorts the rest away.
    """
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("engine")], F.lit(1.0))
    fixed = ("query_id", "engine", "engine_ord", "rank", "title", "url", "snippet")
    others = [c for c in hits.columns if c not in fixed]
    seen = F.struct("engine_ord", "rank")
    longest = lambda c: F.max_by(c, F.struct(F.octet_length(F.coalesce(F.col(c), F.lit(""))), -F.col("engine_ord"), -F.col("rank")))
    h = hits.withColumn("__key", hit_key(F.col("url"), F.col("title")) if key is None else key).withColumn("__w", w / (F.lit(K) + F.col("rank")))
    pages = h.groupBy("query_id", "__key").agg(
        F.array_sort(F.collect_list(F.struct("engine_ord", "rank", "engine", "__w"))).alias("__parts"),
        longest("title").alias("title"),
        longest("snippet").alias("snippet"),
        F.min_by(F.struct("url", *others), seen).alias("__first"),
        F.min(seen).alias("__seen"),
    )
    total = F.aggregate("__parts", F.lit(0.0), lambda acc, x: acc + x["__w"])
    pages = pages.select(
        "query_id",
        "title",
        F.col("__first.url").alias("url"),
        "snippet",
        (F.floor(total * 100 + 0.5) / 100).alias("score"),
        F.array_distinct(F.transform("__parts", lambda x: x["engine"])).alias("sources"),
        *[F.col(f"__first.{c}").alias(c) for c in others],
        "__seen",
    )
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "__seen"))
    ranked = pages.withColumn("rn", rn)
    if limit is not None:
        ranked = ranked.where(F.col("rn") <= limit)
    return ranked.drop("__seen")


def responses(fused: DataFrame, queried: DataFrame, failed: DataFrame) -> DataFrame:
    """One row for each query: results in order, engines that answered, and failures of those that did not."""
    results = fused.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rn", "title", "url", "snippet", "score", "sources"))).alias("results"))
    engines = queried.groupBy("query_id").agg(F.sort_array(F.collect_set("engine")).alias("engines_queried"))
    lost = failed.join(queried.select("query_id", "engine"), ["query_id", "engine"], "left_anti")
    lost = lost.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("engine", "error", "is_rate_limited"))).alias("engines_failed"))
    out = engines.join(results, "query_id", "full").join(lost, "query_id", "full")
    none = F.array()
    return out.select(
        "query_id",
        F.coalesce("results", none.cast(results.schema["results"].dataType)).alias("results"),
        F.coalesce(F.size("results"), F.lit(0)).alias("total_results"),
        F.coalesce("engines_queried", none.cast("array<string>")).alias("engines_queried"),
        F.coalesce("engines_failed", none.cast(lost.schema["engines_failed"].dataType)).alias("engines_failed"),
    )
