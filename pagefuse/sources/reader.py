"""Answers of a reader service, which turns an address into Markdown for its caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_headers(key: str | None = None, wait: bool = False) -> dict[str, str]:
    """Headers of a request: Markdown as the answer, a bearer key where there is one."""
    out = {"Accept": "text/markdown, text/plain", "X-Return-Format": "markdown"}
    if wait:
        out["X-Wait-For-Selector"] = "body"
    return out | ({"Authorization": f"Bearer {key}"} if key else {})


def interpreted(replies: DataFrame, status: str = "status", body: str = "body", retry: str = "retry_after") -> DataFrame:
    """``replies`` with ``markdown``, ``error_kind`` and, for a rate limit, ``retry_after_s`` where the service says it in seconds."""
    s = F.col(status)
    good = F.coalesce(s.between(200, 299), F.lit(False))
    error = F.when(s.isNull(), F.lit("network")).when(s == 429, F.lit("rate_limited")).when(~good, F.lit("reader_failed"))
    return replies.withColumns({"markdown": F.when(good, F.col(body)), "error_kind": error, "retry_after_s": F.when(s == 429, F.col(retry).try_cast("long"))})
