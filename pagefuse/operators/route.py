"""Bodies through the pass of their kind, and rows as a tool hands them on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hardening, htmlclean, kinds, text, urls


def sanitized(bodies: DataFrame, keep: list[str], kind: str = "kind", url: str = "url", body: str = "html", content_type: str | None = "content_type", options: hardening.Hardening = hardening.Hardening(), clean: htmlclean.CleanOptions = htmlclean.CleanOptions()) -> DataFrame:
    """``keep`` columns, ``title`` and ``markdown``: HTML is cleaned, JSON, XML and text take their light passes.

    One pass over the rows; only HTML reaches the cleaner.  ``error`` has what
    the cleaner says.
    """
    is_html = F.col(kind) == "Html"
    ct = kinds.media_type(F.col(content_type)) if content_type else F.lit(None).cast("string")
    src = bodies.select(*keep, F.col(kind).alias("__kind"), F.col(url).alias("__at"), ct.alias("__type"), F.when(is_html, F.col(body)).alias("__page"), F.when(~is_html, F.col(body).cast("string")).alias("__plain"))
    d = htmlclean.cleaned(src, [*keep, "__kind", "__at", "__type", "__plain"], url_col="__at", body_col="__page", options=clean)
    k, plain = F.col("__kind"), F.col("__plain")
    made = kinds.payload(F.when(k == "Html", F.col("markdown")).otherwise(plain), F.when(k != "Html", kinds.fence_language(k, F.col("__type"))), options)
    own = F.when(k == "Html", F.coalesce(F.nullif("title", F.lit("")), text.first_heading(F.col("markdown"), urls.fallback_title(F.col("__at"))))).otherwise(F.coalesce(F.nullif(kinds.payload_title(k, plain), F.lit("")), urls.fallback_title(F.col("__at"))))
    return d.select(*keep, own.alias("__title"), made.alias("__markdown")).withColumnsRenamed({"__title": "title", "__markdown": "markdown"})


def tool_rows(results: DataFrame, most: int, key: str = "query_id", order: str = "rn", url: str = "url") -> DataFrame:
    """One row for each URL of a query, ``most`` at most, with its ``place`` and whether the query had more rows than are kept."""
    totals = results.groupBy(key).agg(F.count(F.lit(1)).alias("__total"))
    first = results.where(F.col(url).isNotNull()).groupBy(key, url).agg(F.min(order).alias("__first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("__first"))
    kept = first.withColumn("place", place).where(F.col("place") <= most)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return kept.withColumn("__kept", n).join(totals, key).select(key, "place", url, (F.col("__total") > F.col("__kept")).alias("truncated"))
