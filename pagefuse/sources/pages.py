"""Raw pages as a source: replay of stored bodies with the checks of a fetch, before any body is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kinds import kind_of_type, media_type, sniff
from ..functions.urls import canonical_url, guard_error

MAX_BYTES = 5 * 1024 * 1024


def replay(pages: DataFrame, url_col: str = "url", body_col: str = "html", type_col: str | None = None, status_col: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``pages`` with ``canonical_url``, ``kind`` and ``error_kind`` (null: may be read).

    The order of checks is that of a fetch: address, status, type, size.
    """
    url, body = F.col(url_col), F.col(body_col)
    given = kind_of_type(media_type(F.col(type_col))) if type_col else F.lit(None).cast("string")
    kind = F.coalesce(given, sniff(body.cast("string"))) if not type_col else F.when(F.col(type_col).isNull(), sniff(body.cast("string"))).otherwise(given)
    status = F.col(status_col) if status_col else F.lit(200)
    error = (
        F.coalesce(
            guard_error(url),
            F.when(status == 429, F.lit("rate_limited")).when(status == 403, F.lit("blocked")).when(~status.between(200, 299), F.lit("network")),
            F.when(kind.isNull(), F.lit("unsupported_content_type")),
            F.when(F.octet_length(body) > max_bytes, F.lit("too_large")),
        )
    )
    return pages.withColumns({"canonical_url": canonical_url(url), "kind": kind, "error_kind": error})
