"""Rows from JSON replies by declarative specs: where the items are and which path fills which field.

A reply is one row (query_id, engine, payload).  Items come from one
``posexplode`` in their order, fields are path expressions, so the whole is one
projection without Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_tags


@dataclass(frozen=True)
class Field:
    """A path, a path if the first is missing, a prefix, and whether tags go."""

    path: str
    fallback: str | None = None
    prefix: str = ""
    strip_html: bool = False


@dataclass(frozen=True)
class Spec:
    """Where items are (``None``: the reply is the list) and what fills each field."""

    results: str | None
    title: Field
    url: Field
    snippet: Field | None = None
    thumbnail: Field | None = None
    date: Field | None = None
    metadata: dict[str, Field] = field(default_factory=dict)


def json_path(dotted: str) -> str:
    """``a.0.b`` as ``$.a[0].b``; names that are no identifiers are quoted."""
    out = "$"
    for s in dotted.split("."):
        out += f"[{s}]" if s.isdigit() else f".{s}" if re.fullmatch(r"\w+", s) else f"['{s}']"
    return out


def field_value(item: Column, f: Field) -> Column:
    """Text of a field: trimmed, then prefixed, then without tags; null if missing or blank.

    A JSON null at the first path counts as found, so the other isn't tried.
    """
    first = F.get_json_object(item, json_path(f.path))
    if f.fallback:
        null_there = F.coalesce(F.is_variant_null(F.try_variant_get(F.try_parse_json(item), json_path(f.path), "variant")), F.lit(False))
        first = F.when(~null_there, F.coalesce(first, F.get_json_object(item, json_path(f.fallback))))
    x = F.trim(first)
    x = F.when(x != "", x)
    if f.prefix:
        x = F.concat(F.lit(f.prefix), x)
    return strip_tags(x) if f.strip_html else x


def items_of(payload: Column, results: str | None) -> Column:
    """The items of a reply as JSON texts, null where there is no list."""
    at = payload if results is None else F.get_json_object(payload, json_path(results))
    return F.when(at.startswith("["), F.from_json(at, "array<string>"))


def extract(replies: DataFrame, spec: Spec) -> DataFrame:
    """One hit for each item with a URL; ``rank`` counts the hits of a reply from 1."""
    each = replies.select("query_id", "engine", F.posexplode(items_of(F.col("payload"), spec.results)).alias("pos", "item"))
    item = F.col("item")
    none = F.lit(None).cast("string")
    get = lambda f: field_value(item, f) if f else none
    meta = F.map_filter(F.create_map(*[x for k, f in spec.metadata.items() for x in (F.lit(k), field_value(item, f))]), lambda k, v: v.isNotNull()) if spec.metadata else F.create_map().cast("map<string,string>")
    hits = each.select("query_id", "engine", "pos", F.coalesce(get(spec.title), F.lit("")).alias("title"), get(spec.url).alias("url"), F.coalesce(get(spec.snippet), F.lit("")).alias("snippet"), get(spec.date).alias("published_date"), get(spec.thumbnail).alias("thumbnail_url"), meta.alias("metadata"))
    return ranked(hits.where("url IS NOT NULL"))


def ranked(hits: DataFrame, cap: int | None = None) -> DataFrame:
    """Hits with ``rank`` from 1 in order of ``pos`` within a reply, ``cap`` at most."""
    from pyspark.sql.window import Window

    r = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "engine").orderBy("pos")))
    return (r.where(F.col("rank") <= cap) if cap else r).drop("pos")


def parse_failures(replies: DataFrame, spec: Spec) -> DataFrame:
    """Replies without a list where the spec expects one."""
    return replies.where(items_of(F.col("payload"), spec.results).isNull()).select("query_id", "engine", F.lit("no result list in reply").alias("error"), F.lit(False).alias("is_rate_limited"))


#: Public JSON interfaces, by engine name.
SPECS: dict[str, Spec] = {
    "mdn": Spec("documents", Field("title"), Field("mdn_url", prefix="https://developer.mozilla.org"), Field("summary")),
    "packagist": Spec("results", Field("name"), Field("url"), Field("description")),
    "wiby": Spec(None, Field("Title"), Field("URL"), Field("Snippet")),
    "crowdview": Spec("results", Field("title"), Field("url"), Field("content")),
    "encyclosearch": Spec("Results", Field("Title"), Field("Url"), Field("Description")),
    "mankier": Spec("results", Field("name"), Field("url"), Field("description")),
    "crates.io": Spec("crates", Field("name"), Field("name", prefix="https://crates.io/crates/"), Field("description"), date=Field("updated_at"), metadata={"downloads": Field("downloads")}),
    "github": Spec("items", Field("full_name"), Field("html_url"), Field("description"), metadata={"stars": Field("stargazers_count"), "language": Field("language")}),
    "npm": Spec("objects", Field("package.name"), Field("package.name", prefix="https://www.npmjs.com/package/"), Field("package.description"), metadata={"version": Field("package.version")}),
    "docker_hub": Spec("results", Field("repo_name"), Field("repo_name", prefix="https://hub.docker.com/r/"), Field("short_description"), metadata={"stars": Field("star_count")}),
    "openalex": Spec("results", Field("display_name"), Field("doi", "id"), metadata={"year": Field("publication_year"), "cited_by": Field("cited_by_count")}),
    "crossref": Spec("message.items", Field("title.0"), Field("DOI", prefix="https://doi.org/"), Field("abstract", strip_html=True), date=Field("created.date-time")),
    "semantic_scholar": Spec("data", Field("title"), Field("url"), Field("abstract"), date=Field("year")),
    "openlibrary": Spec("docs", Field("title"), Field("key", prefix="https://openlibrary.org"), metadata={"author": Field("author_name.0"), "year": Field("first_publish_year")}),
    "hex": Spec(None, Field("name"), Field("name", prefix="https://hex.pm/packages/"), Field("meta.description"), date=Field("updated_at")),
    "gitlab": Spec(None, Field("name_with_namespace"), Field("web_url"), Field("description")),
    "hackernews": Spec("hits", Field("title", "story_title"), Field("objectID", prefix="https://news.ycombinator.com/item?id="), date=Field("created_at"), metadata={"points": Field("points"), "comments": Field("num_comments")}),
    "national_vulnerability_database": Spec("vulnerabilities", Field("cve.id"), Field("cve.id", prefix="https://nvd.nist.gov/vuln/detail/"), Field("cve.descriptions.0.value")),
    "tagesschau": Spec("searchResults", Field("title"), Field("shareURL"), date=Field("date")),
    "dailymotion": Spec("list", Field("title"), Field("id", prefix="https://www.dailymotion.com/video/"), thumbnail=Field("thumbnail_240_url")),
    "deezer": Spec("data", Field("title"), Field("link"), thumbnail=Field("album.cover_medium"), metadata={"artist": Field("artist.name")}),
    "mixcloud": Spec("data", Field("name"), Field("url"), thumbnail=Field("pictures.medium"), metadata={"user": Field("user.username")}),
    "radio_browser": Spec(None, Field("name"), Field("url_resolved"), thumbnail=Field("favicon"), metadata={"country": Field("country"), "codec": Field("codec")}),
    "openverse": Spec("results", Field("title"), Field("foreign_landing_url"), thumbnail=Field("thumbnail"), metadata={"creator": Field("creator"), "license": Field("license")}),
    "unsplash": Spec("results", Field("alt_description"), Field("links.html"), thumbnail=Field("urls.small"), metadata={"user": Field("user.username")}),
    "hoogle": Spec(None, Field("name"), Field("url")),
    "gitea": Spec("data", Field("full_name"), Field("html_url"), Field("description"), metadata={"stars": Field("stars_count")}),
    "wikidata": Spec("search", Field("label"), Field("concepturi"), Field("description"), metadata={"entity_id": Field("id")}),
    "ddg_videos": Spec(None, Field("title"), Field("url"), Field("description"), Field("images.medium"), metadata={"publisher": Field("publisher"), "duration": Field("duration")}),
    "ddg_images": Spec(None, Field("title"), Field("url", "image"), thumbnail=Field("thumbnail"), metadata={"image": Field("image"), "width": Field("width"), "height": Field("height")}),
}
