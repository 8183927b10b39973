"""What becomes of a page that a browser must render: a decision table over outcome columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WARNING = "The page needs a browser and no renderer answered; this is its static content."


def ladder(is_spa: Column, reader_status: Column, keyed_status: Column, headless_ok: Column, wait_ok: Column) -> Column:
    """(method, warning): static pages as they are; else the reader, and where its quota is spent the keyed
    reader, the local browser, a wait that succeeded, and the static page with a warning.

    Statuses are HTTP codes, or null for none tried; 429 stands for a spent quota.
    """
    good = lambda s: F.coalesce(s.between(200, 299), F.lit(False))
    limited = F.coalesce(reader_status == 429, F.lit(False))
    method = (
        F.when(~is_spa, F.lit("StaticDirect"))
        .when(good(reader_status), F.lit("JinaReader"))
        .when(limited & good(keyed_status), F.lit("JinaReader"))
        .when(limited & F.coalesce(headless_ok, F.lit(False)), F.lit("LocalHeadless"))
        .when(limited & F.coalesce(wait_ok, F.lit(False)), F.lit("JinaReader"))
        .otherwise(F.lit("DegradedStatic"))
    )
    return F.struct(method.alias("method"), F.when(method == "DegradedStatic", F.lit(WARNING)).alias("warning"))


def wait_delays(retry_after: Column, tries: int = 2, most: int = 60) -> Column:
    """Seconds before each retry: what the server asks for or 1, doubling, ``most`` at most; none if it asks for more."""
    first = F.coalesce(retry_after, F.lit(1)).cast("long")
    doubled = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda k: F.least(first * F.pow(F.lit(2), k).cast("long"), F.lit(most).cast("long")))
    return F.when(first > most, F.array().cast("array<bigint>")).otherwise(doubled)


def parse_render_method(name: Column) -> Column:
    """A known render method; anything else is a static page."""
    return F.when(name.isin("StaticDirect", "JinaReader", "LocalHeadless", "DegradedStatic", "Cache"), name).otherwise(F.lit("StaticDirect"))
