"""JSON replies of any number of engines by specs that are rows of a table, in one plan.

A reply is parsed once, as a VARIANT; its engine's row says where the items are
and which path fills which field, and the paths are values, not part of the
plan.  So thirty engines are one stage, and an engine is added by adding a row.

The rules are those of ``json_replies``: a JSON null at the first path counts as
found, texts are trimmed, then prefixed, then freed of tags, blanks are null, an
item without a URL is left out.  Numbers are written in their shortest form,
whole decimals with ``.0``.  Members of objects come in order of their names.

Edge cases: a payload that is no JSON, or has no list where the spec says, gives
no hits and one failure; so does an engine without a row.  Several rows of one
engine are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_tags
from ..functions.urls import once
from .json_replies import SPECS, Field, Spec, json_path, ranked

SCHEMA = "engine string, results string, fields array<struct<name:string,path:string,fallback:string,prefix:string,strip_html:boolean>>"
#: Fields that become columns; all others are metadata.
COLUMNS = ("title", "url", "snippet", "published_date", "thumbnail_url")
#: Specs that are sent to all tasks; more are joined by a shuffle.
SENT = 10_000


def rows_of(specs: dict[str, Spec]) -> list[tuple]:
    """Specs as rows of ``SCHEMA``."""

    def one(name: str, f: Field) -> tuple:
        return name, json_path(f.path), json_path(f.fallback) if f.fallback else None, f.prefix, f.strip_html

    out = []
    for engine, s in specs.items():
        own = {"title": s.title, "url": s.url, "snippet": s.snippet, "published_date": s.date, "thumbnail_url": s.thumbnail, **{f"metadata.{k}": f for k, f in s.metadata.items()}}
        out.append((engine, json_path(s.results) if s.results else "$", [one(n, f) for n, f in own.items() if f]))
    return out


def known(spark: SparkSession) -> DataFrame:
    """The specs of the engines that ship."""
    return spark.createDataFrame(rows_of(SPECS), SCHEMA)


def text_of(v: Column) -> Column:
    """A variant as text: null for JSON null, whole decimals with their zero."""
    t = v.try_cast("string")
    return F.when(t.rlike(r"^-?\d+$") & F.schema_of_variant(v).startswith("DECIMAL"), F.concat(t, F.lit(".0"))).otherwise(t)


def parsed(replies: DataFrame, specs: DataFrame) -> DataFrame:
    """Replies with ``results``, ``fields`` and ``found``, the variant where the items should be."""
    count = specs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("engine").alias("d")).first()
    if count.n != count.d:
        raise ValueError("an engine has several specs")
    s = specs.select(F.col("engine").alias("__engine"), "results", "fields")
    s = F.broadcast(s) if count.n <= SENT else s
    d = replies.select("query_id", "engine", "payload").join(s, F.col("engine") == F.col("__engine"), "left")
    return d.select("query_id", "engine", "fields", F.expr("try_variant_get(try_parse_json(payload), results, 'variant')").alias("found"))


def is_list(v: Column) -> Column:
    """Whether a variant is a list."""
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def extract(replies: DataFrame, specs: DataFrame) -> DataFrame:
    """Hits of replies (query_id, engine, payload) of all engines in ``specs``, as ``json_replies.extract`` has them."""
    spark = replies.sparkSession
    d = parsed(replies, specs).alias("d")
    each = d.lateralJoin(spark.tvf.variant_explode(F.col("d.found").outer()).alias("i")).where("i.key IS NULL")  # items of lists have no key
    each = each.select("query_id", "engine", "fields", F.col("i.pos").alias("pos"), F.col("i.value").alias("item"))

    def value(f: Column) -> Column:
        at = lambda path: F.call_function("try_variant_get", F.col("item"), path, F.lit("variant"))
        first = once(at(f["path"]), lambda v: F.when(v.isNotNull(), v).otherwise(at(f["fallback"])))
        trimmed = once(first, lambda v: F.trim(text_of(v)))
        whole = once(trimmed, lambda x: F.when(x != "", F.concat(f["prefix"], x)))
        return once(whole, lambda x: F.when(f["strip_html"], strip_tags(x)).otherwise(x))

    def hit(m: Column) -> Column:
        of = lambda c: F.try_element_at(m, F.lit(c))
        meta = F.transform_keys(F.map_filter(m, lambda k, v: k.startswith("metadata.") & v.isNotNull()), lambda k, v: F.substr(k, F.lit(len("metadata.") + 1)))
        none = F.lit("")
        return F.struct(F.coalesce(of("title"), none).alias("title"), of("url").alias("url"), F.coalesce(of("snippet"), none).alias("snippet"), of("published_date").alias("published_date"), of("thumbnail_url").alias("thumbnail_url"), meta.alias("metadata"))

    # as a list that is exploded, the hit is worked out once however often it is named
    made = F.transform(F.array(F.map_from_entries(F.transform("fields", lambda f: F.struct(f["name"].alias("key"), value(f).alias("value"))))), hit)
    hits = each.select("query_id", "engine", "pos", F.inline(F.filter(made, lambda h: h["url"].isNotNull())))
    return ranked(hits)


def failures(replies: DataFrame, specs: DataFrame) -> DataFrame:
    """Replies without a list where their spec expects one, and those of engines without a spec."""
    d = parsed(replies, specs).where(~is_list(F.col("found")))
    error = F.when(F.col("fields").isNull(), F.lit("engine has no spec")).otherwise(F.lit("no result list in reply"))
    return d.select("query_id", "engine", error.alias("error"), F.lit(False).alias("is_rate_limited"))
