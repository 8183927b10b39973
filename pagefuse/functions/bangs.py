"""Query shortcuts: tokens like ``!gh`` that route a query to engines or to a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE

#: Categories in their order, with their shortcuts.
CATEGORIES = ["general", "images", "videos", "news", "map", "music", "it", "science", "files", "social_media"]
ALIASES = {"maps": "map", "social media": "social_media"}


def category(name: Column) -> Column:
    """A category from free input: trimmed, lower case, hyphens as underscores, aliases; null if unknown."""
    x = F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_"))
    for alias, to in ALIASES.items():
        x = F.when(x == alias, F.lit(to)).otherwise(x)
    return F.when(x.isin(CATEGORIES), x)


def parse_bangs(query: Column) -> Column:
    """(clean_query, bangs): bangs in lower case and in order, the other words joined by one space."""
    tokens = F.filter(F.split(query, SPACE), lambda t: t != "")
    is_bang = lambda t: t.rlike("^!+[A-Za-z0-9_]+$")
    return F.struct(
        F.array_join(F.filter(tokens, lambda t: ~is_bang(t)), " ").alias("clean_query"),
        F.transform(F.filter(tokens, is_bang), lambda t: F.lower(F.regexp_replace(t, "^!+", ""))).alias("bangs"),
    )


def resolve_bangs(queries: DataFrame, engines: DataFrame, id_col: str = "query_id", bangs_col: str = "bangs") -> DataFrame:
    """(id, engines, category): a category's shortcut sets the category, the last one wins; an engine's adds the
    engine and its first category if none is set yet.  Unknown shortcuts are left out.

    ``engines`` is a dimension (name, bang, categories), joined by the
    shortcut; the fold over a query's shortcuts is an ordered aggregate.
    """
    dim = engines.select(F.col("bang").alias("__bang"), F.col("name").alias("__name"), F.get("categories", F.lit(0)).alias("__cat"))
    each = queries.select(id_col, F.posexplode_outer(bangs_col).alias("pos", "bang"))
    hit = each.join(dim, F.col("bang") == F.col("__bang"), "left")
    own = category(F.col("bang"))
    step = F.struct("pos", own.alias("cat"), F.when(own.isNull(), F.col("__name")).alias("engine"), F.col("__cat").alias("ecat"))
    folded = hit.groupBy(id_col).agg(F.array_sort(F.collect_list(step)).alias("s"))
    cat = F.aggregate("s", F.lit(None).cast("string"), lambda acc, x: F.coalesce(x["cat"], acc, F.when(x["engine"].isNotNull(), x["ecat"])))
    names = F.filter(F.transform("s", lambda x: x["engine"]), lambda e: e.isNotNull())
    return folded.select(id_col, names.alias("engines"), cat.alias("category"))
