"""One search over many engines: assemble queries, select engines, run them, fuse what they return."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bangs import category, parse_bangs, resolve_bangs
from .fuse import fuse, responses
from .registry import CAP, select_engines


class Engine(Protocol):
    """Takes queries (query_id, clean_query, page, ...); returns hits (query_id, rank, title, url, snippet) and,
    where it can tell, failures (query_id, error, is_rate_limited)."""

    def __call__(self, queries: DataFrame) -> tuple[DataFrame, DataFrame | None]: ...


def assembled(raw: DataFrame, engines: DataFrame) -> DataFrame:
    """Full queries from (query_id, query, and optional category, engines, page, safe_search, limit, max_engines).

    The category comes from a shortcut, else the column, else it is general;
    engines named by shortcuts come before those in the column; pages start at
    1 and the safe-search level is between 0 and 2.
    """
    have = set(raw.columns)
    col = lambda c, kind, default: F.coalesce(F.col(c).cast(kind), F.lit(default).cast(kind)) if c in have else F.lit(default).cast(kind)
    q = raw.withColumn("__p", parse_bangs(F.col("query"))).withColumn("bangs", F.col("__p.bangs"))
    routed = resolve_bangs(q, engines).select(F.col("query_id").alias("__q"), F.col("engines").alias("__e"), F.col("category").alias("__c"))
    j = q.join(routed, F.col("query_id") == F.col("__q"), "left")
    own = category(F.col("category")) if "category" in have else F.lit(None).cast("string")
    named = F.coalesce("engines", F.array().cast("array<string>")) if "engines" in have else F.array().cast("array<string>")
    return j.select(
        "query_id",
        F.col("query").alias("raw_query"),
        F.col("__p.clean_query").alias("clean_query"),
        F.get("bangs", F.lit(0)).alias("bang"),
        F.coalesce("__c", own, F.lit("general")).alias("category"),
        F.array_distinct(F.concat(F.coalesce("__e", F.array().cast("array<string>")), named)).alias("engines"),
        F.greatest(col("page", "int", 1), F.lit(1)).alias("page"),
        F.least(F.greatest(col("safe_search", "int", 1), F.lit(0)), F.lit(2)).alias("safe_search"),
        F.greatest(col("limit", "int", 10), F.lit(1)).alias("limit"),
        col("max_engines", "int", None).alias("max_engines"),
    )


def search(queries: DataFrame, engines: DataFrame, run: dict[str, Engine], weights: dict[str, float] | None = None, cap: int = CAP, limit: int = 10) -> DataFrame:
    """Responses for assembled queries; ``run`` has the engine functions by name.

    Each engine is called once, with the queries that selected it.  A selected
    engine without a function is a failure.  Engine order within a query is the
    order of selection.
    """
    selected, failed = select_engines(queries, engines, cap)
    hits, lost = [], [failed]
    known = list(run)
    lost.append(selected.where(~F.col("engine").isin(known)).select("query_id", "engine", F.lit("engine has no function").alias("error"), F.lit(False).alias("is_rate_limited")))
    for name, f in run.items():
        mine = selected.where(F.col("engine") == name).select("query_id", "engine_ord")
        got, bad = f(queries.join(mine, "query_id"))
        hits.append(got.join(mine, "query_id").select("query_id", F.lit(name).alias("engine"), "engine_ord", "rank", "title", "url", "snippet"))
        if bad is not None:
            lost.append(bad.select("query_id", F.lit(name).alias("engine"), "error", "is_rate_limited"))
    every = reduce(DataFrame.unionByName, hits)
    return responses(fuse(every, weights, limit), every.select("query_id", "engine").distinct(), reduce(DataFrame.unionByName, lost))
