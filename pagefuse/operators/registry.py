"""The engine registry: rows, overlays, checks, counts, and which engines a query uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bangs import CATEGORIES

#: Families that only answer when they are named.
INSTANT = ["currency_convert", "translated", "lingva", "dictzone", "tineye", "mozhi"]
#: Engines that one query uses at most.
CAP = 12
SCHEMA = "name string, display string, bang string, family string, categories array<string>, enabled boolean, timeout_ms long, weight double, paging boolean, locale boolean, safe_search boolean, time_range boolean, wave int, implemented boolean"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows from a JSON-lines file by any path that Spark reads."""
    return spark.read.schema(SCHEMA).json(path)


def load_toml(spark: SparkSession, text: str) -> DataFrame:
    """Registry rows from TOML text with an ``engines`` list; rows without ``implemented`` are."""
    import tomllib

    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = tomllib.loads(text).get("engines", [])
    base = {"display": None, "enabled": True, "timeout_ms": 3000, "weight": 1.0, "paging": False, "locale": False, "safe_search": False, "time_range": False, "wave": 1, "implemented": True}
    return spark.createDataFrame([tuple(float(v) if k == "weight" else v for k, v in ((n, (base | r).get(n)) for n in names)) for r in rows], SCHEMA)


def from_tables(texts: DataFrame) -> DataFrame:
    """Registry rows from Markdown documents (doc, text) with a table of engines below the heading of each category.

    A heading names its category in backticks with an exclamation mark.  An
    engine that several tables list has the fields of the first and all their
    categories.  Names are the shown ones in lower case with underscores, without
    a language in brackets.
    """
    lines = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    tab = F.regexp_extract("x", r"^#+ .*`!([a-z_]+)`", 1)
    own = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    cells = F.transform(F.split(F.regexp_replace(F.trim("x"), r"^\||\|$", ""), r"\|"), lambda c: F.regexp_replace(F.trim(c), "^`!?|`$", ""))
    rows = lines.withColumn("category", F.last(F.nullif(tab, F.lit("")), ignorenulls=True).over(own)).where(F.trim("x").startswith("|")).withColumn("c", cells)
    at = lambda k: F.get("c", F.lit(k))
    rows = rows.where((F.size("c") >= 11) & at(3).isin("on", "off") & F.col("category").isNotNull())
    yes = lambda k: at(k) == "✓"
    name = F.regexp_replace(F.trim(F.regexp_replace(F.lower(at(0)), r"\s*\([a-z]{2}\)\s*$", "")), r"\s+", "_")
    fields = F.struct(
        at(0).alias("display"), at(1).alias("bang"), at(2).alias("family"), (at(3) == "on").alias("enabled"), F.round(at(4).cast("double") * 1000).cast("long").alias("timeout_ms"), at(5).cast("double").alias("weight"),
        yes(6).alias("paging"), yes(7).alias("locale"), yes(8).alias("safe_search"), yes(9).alias("time_range"), at(10).cast("int").alias("wave"),
    )
    order = F.struct("doc", "line")
    merged = rows.groupBy(name.alias("name")).agg(F.min_by(fields, order).alias("f"), F.array_sort(F.collect_list(F.struct("doc", "line", "category"))).alias("tabs"))
    return merged.select("name", "f.*", F.array_distinct(F.transform("tabs", lambda t: t["category"])).alias("categories"))


def overlaid(engines: DataFrame, fragments: DataFrame) -> DataFrame:
    """Registry rows with the fields that a fragment of the same name sets."""
    own = [c for c in engines.columns if c != "name"]
    more = [c for c in fragments.columns if c != "name" and c not in own]
    f = fragments.select(F.col("name").alias("__n"), *[F.col(c).alias(f"__f_{c}") for c in fragments.columns if c != "name"])
    j = engines.join(f, F.col("name") == F.col("__n"), "left")
    return j.select("name", *[F.coalesce(f"__f_{c}", c).alias(c) if c in fragments.columns else F.col(c) for c in own], *[F.col(f"__f_{c}").alias(c) for c in more])


def duplicates(engines: DataFrame) -> DataFrame:
    """Names and bangs that more than one row has: (field, value, n); empty for a valid registry."""
    each = engines.select(F.explode(F.array(F.struct(F.lit("name").alias("field"), F.col("name").alias("value")), F.struct(F.lit("bang").alias("field"), F.col("bang").alias("value")))).alias("x"))
    return each.groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def category_counts(engines: DataFrame) -> DataFrame:
    """Engines, enabled and implemented ones of each category."""
    each = engines.select(F.explode("categories").alias("category"), "enabled", "implemented")
    return each.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("enabled").alias("n_enabled"), F.count_if("implemented").alias("n_implemented"))


def engines_for_category(engines: DataFrame, category: str, include_disabled: bool = False) -> DataFrame:
    """Implemented engines of a category, heaviest first, without those that must be named."""
    on = F.lit(True) if include_disabled else F.col("enabled")
    return engines.where(F.array_contains("categories", category) & F.col("implemented") & on & ~F.col("family").isin(INSTANT)).orderBy(F.desc("weight"), "name")


def select_engines(queries: DataFrame, engines: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(selected, failures) for queries of (query_id, category, engines, max_engines).

    Named engines come in the order named; unknown and unimplemented ones are
    failures.  A query with no usable name uses its category's engines.
    ``selected``: query_id, engine, engine_ord from 0, by_category.
    """
    spec = engines.select(F.col("name").alias("__name"), "implemented", "family", F.col("categories").alias("__cats"), "enabled", "weight")
    named = queries.select("query_id", F.posexplode(F.array_distinct("engines")).alias("pos", "engine")).join(spec, F.col("engine") == F.col("__name"), "left")
    failures = named.where("implemented IS NULL OR NOT implemented").select("query_id", "engine", F.when(F.col("implemented").isNull(), F.lit("unknown engine")).otherwise(F.lit("engine not implemented")).alias("error"), F.lit(False).alias("is_rate_limited"))
    usable = named.where("implemented").select("query_id", "engine", F.struct(F.lit(0.0).alias("w"), F.col("pos").cast("string").alias("n"), "pos").alias("__o"), F.lit(False).alias("by_category"))
    rest = queries.join(usable.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "category")
    pool = spec.where(F.col("implemented") & F.col("enabled") & ~F.col("family").isin(INSTANT)).select(F.explode("__cats").alias("__c"), "__name", "weight")
    by_cat = rest.join(pool, F.col("category") == F.col("__c")).select("query_id", F.col("__name").alias("engine"), F.struct((-F.col("weight")).alias("w"), F.col("__name").alias("n"), F.lit(0).alias("pos")).alias("__o"), F.lit(True).alias("by_category"))
    both = usable.union(by_cat).join(queries.select("query_id", "max_engines"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("__o.w"), F.when(F.col("by_category"), F.lit(0)).otherwise(F.col("__o.pos")), F.col("__o.n"))
    ranked = both.withColumn("engine_ord", F.row_number().over(order) - 1).where(F.col("engine_ord") < F.coalesce("max_engines", F.lit(cap)))
    return ranked.select("query_id", "engine", "engine_ord", "by_category"), failures


def listing(engines: DataFrame, category: str | None = None, implemented: bool | None = None) -> DataFrame:
    """Registry rows of a category, or only those that can or can't be run, by name."""
    out = engines
    if category:
        out = out.where(F.array_contains("categories", category))
    if implemented is not None:
        out = out.where(F.col("implemented") == implemented)
    return out.orderBy("name")


def bang_listing(engines: DataFrame, contains: str | None = None) -> DataFrame:
    """(ord, bang, target, kind): shortcuts of categories in their order, then those of engines by name.

    ``contains`` keeps rows whose shortcut or target has it.
    """
    spark = engines.sparkSession
    cats = spark.createDataFrame([(i, c, c, "category") for i, c in enumerate(CATEGORIES)], "ord int, bang string, target string, kind string")
    own = engines.select(F.lit(len(CATEGORIES)).alias("ord"), "bang", F.col("name").alias("target"), F.lit("engine").alias("kind"))
    out = cats.unionByName(own)
    if contains:
        out = out.where(F.col("bang").contains(contains.lower()) | F.lower("target").contains(contains.lower()))
    return out.orderBy("ord", "target")


def switched(engines: DataFrame, overrides: dict[str, bool]) -> DataFrame:
    """Registry rows with engines switched on or off by name."""
    if not overrides:
        return engines
    on = F.create_map(*[x for k, v in overrides.items() for x in (F.lit(k), F.lit(v))])
    return engines.withColumn("enabled", F.coalesce(on[F.col("name")], F.col("enabled")))
