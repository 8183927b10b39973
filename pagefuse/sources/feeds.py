"""Rows from Atom feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities, normalize_ws
from .json_replies import ranked


def atom(replies: DataFrame) -> DataFrame:
    """One hit for each entry with an id and a title; the paper's number follows ``/abs/``, the date is its first ten characters."""
    entries = F.regexp_extract_all("payload", F.lit(r"(?s)<entry(?:\s[^>]*)?>(.*?)</entry>"), F.lit(1))
    each = replies.select("query_id", "engine", F.posexplode(entries).alias("pos", "e"))
    tag = lambda t: F.regexp_extract("e", rf"(?s)<{t}(?:\s[^>]*)?>(.*?)</{t}>", 1)
    clean = lambda t: normalize_ws(decode_entities(tag(t)))
    h = each.select(
        "query_id", "engine", "pos", clean("title").alias("title"), F.trim(tag("id")).alias("url"), clean("summary").alias("snippet"), F.nullif(F.substring(F.trim(tag("published")), 1, 10), F.lit("")).alias("published_date"),
        F.create_map(F.lit("arxiv_id"), F.regexp_extract(tag("id"), "/abs/([^<\\s]+)", 1)).alias("metadata"),
    )
    return ranked(h.where("title <> '' AND url <> ''"))
