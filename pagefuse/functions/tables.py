"""Table functions for SQL, whose columns follow from their arguments.

``fuse_hits(TABLE(hits), 10, map('kw', 2.0))`` is ``operators.fuse.fuse``: it asks
Spark for the hits of a query together and in order, keeps one query in memory
and hands on whatever other columns the table has.  ``json_hits(TABLE(replies),
'{"results": "data.items", "title": "name", "url": "id", ...}')`` reads replies by
a spec in JSON; each field that the spec names beyond the usual ones is a column.

Both are Python, row by row, for use from SQL; the DataFrame forms stay in the JVM.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .urls import canonical_text

_FIXED = ("query_id", "engine", "engine_ord", "rank", "title", "url", "snippet")
_FIELDS = ("title", "url", "snippet", "published_date", "thumbnail_url")


def table_columns(argument: AnalyzeArgument, needed: tuple[str, ...]) -> list:
    """The fields of a TABLE argument, which must have the needed columns."""
    if not argument.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    fields = argument.dataType.fields
    missing = [c for c in needed if c not in {f.name for f in fields}]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return fields


@udtf
class FuseHits:
    """``fuse_hits(TABLE(hits) [, limit [, weights]])``; a null limit keeps all."""

    @staticmethod
    def analyze(hits: AnalyzeArgument, limit: AnalyzeArgument | None = None, weights: AnalyzeArgument | None = None) -> AnalyzeResult:
        """The hits' own columns, then score, sources and place; a query is a partition."""
        fields = table_columns(hits, _FIXED)
        own = {f.name: f.dataType for f in fields}
        out = StructType().add("query_id", own["query_id"]).add("title", StringType()).add("url", StringType()).add("snippet", StringType()).add("score", DoubleType()).add("sources", ArrayType(StringType()))
        for f in fields:
            if f.name not in _FIXED:
                out = out.add(f.name, f.dataType)
        return AnalyzeResult(out.add("rn", IntegerType()), partitionBy=[PartitioningColumn("query_id")], orderBy=[OrderingColumn("engine_ord"), OrderingColumn("rank")])

    def __init__(self) -> None:
        self.pages: dict[str, dict] = {}
        self.limit: int | None = 10

    def eval(self, hits: Row, limit: int | None = 10, weights: dict[str, float] | None = None) -> Iterator[tuple]:
        """One hit, in order of engine and rank."""
        h, self.limit = hits.asDict(), limit
        key = canonical_text(h["url"]) or "nourl:" + (h["title"] or "")
        p = self.pages.setdefault(key, {"first": h, "title": h["title"], "snippet": h["snippet"], "score": 0.0, "sources": []})
        p["score"] += float((weights or {}).get(h["engine"], 1.0)) / (60 + h["rank"])
        if h["engine"] not in p["sources"]:
            p["sources"].append(h["engine"])
        for c in ("title", "snippet"):
            if h[c] is not None and (p[c] is None or len(h[c].encode()) > len(p[c].encode())):
                p[c] = h[c]
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        """The ranking of one query; pages of one score in the order seen."""
        pages = list(self.pages.values())
        for p in pages:
            p["score"] = math.floor(p["score"] * 100 + 0.5) / 100
        pages.sort(key=lambda p: -p["score"])
        for rn, p in enumerate(pages[: self.limit] if self.limit is not None else pages, 1):
            h = p["first"]
            yield (h["query_id"], p["title"], h["url"], p["snippet"], p["score"], p["sources"], *(v for c, v in h.items() if c not in _FIXED), rn)
        self.pages = {}


def at_path(value: object, dotted: str | None) -> object:
    """The value at ``a.b.0``; the value itself without a path, a LookupError where there is none."""
    for s in dotted.split(".") if dotted else []:
        if isinstance(value, list):
            value = value[int(s)] if s.isdigit() and int(s) < len(value) else _missing()
        else:
            value = value[s] if isinstance(value, dict) and s in value else _missing()
    return value


def _missing() -> object:
    raise LookupError


def json_text(value: object) -> str | None:
    """A JSON value as text."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@udtf
class JsonHits:
    """``json_hits(TABLE(replies), spec)``: hits of (query_id, engine, payload) by a spec in JSON.

    The spec has ``results`` (a path, or none where the reply is the list) and a
    path for each field; instead of a path, ``{"path", "fallback", "prefix", "strip_html"}``.
    """

    @staticmethod
    def analyze(replies: AnalyzeArgument, spec: AnalyzeArgument) -> AnalyzeResult:
        """query_id, engine, rank, and a column for each field of the spec."""
        fields = {f.name: f.dataType for f in table_columns(replies, ("query_id", "engine", "payload"))}
        if not spec.isConstantExpression or not isinstance(spec.value, str):
            raise ValueError("the spec must be a fixed text")
        own = json.loads(spec.value)
        if "url" not in own:
            raise ValueError("the spec has no url")
        out = StructType().add("query_id", fields["query_id"]).add("engine", StringType()).add("rank", IntegerType())
        for name in [*(c for c in _FIELDS if c in own), *(c for c in own if c not in _FIELDS and c != "results")]:
            out = out.add(name, StringType())
        return AnalyzeResult(out)

    def __init__(self) -> None:
        self.spec: dict | None = None

    def eval(self, replies: Row, spec: str) -> Iterator[tuple]:
        """The hits of one reply, with ranks from 1."""
        if self.spec is None:
            own = json.loads(spec)
            self.results = own.pop("results", None)
            self.spec = {c: {"path": own[c]} if isinstance(own[c], str) else own[c] for c in [*(c for c in _FIELDS if c in own), *(c for c in own if c not in _FIELDS)]}
        try:
            items = at_path(json.loads(replies["payload"] or ""), self.results)
        except (ValueError, LookupError):
            return
        rank = 0
        for item in items if isinstance(items, list) else []:
            values = {c: self.field(item, f) for c, f in self.spec.items()}
            if values["url"] is not None:
                rank += 1
                yield (replies["query_id"], replies["engine"], rank, *(v if v is not None or c not in ("title", "snippet") else "" for c, v in values.items()))

    @staticmethod
    def field(item: object, f: dict) -> str | None:
        """Trimmed, prefixed, without tags; null if missing or blank; a JSON null counts as found."""
        try:
            x = at_path(item, f["path"])
        except LookupError:
            try:
                x = at_path(item, f["fallback"]) if f.get("fallback") else None
            except LookupError:
                x = None
        x = (json_text(x) or "").strip(" ")
        if not x:
            return None
        x = f.get("prefix", "") + x
        return re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", x)).strip(" ") if f.get("strip_html") else x


def register(spark: SparkSession) -> list[str]:
    """Make the table functions known to SQL; returns their names."""
    for name, f in (("fuse_hits", FuseHits), ("json_hits", JsonHits)):
        spark.udtf.register(name, f)
    return ["fuse_hits", "json_hits"]
