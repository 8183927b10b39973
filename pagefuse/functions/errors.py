"""Tags of errors, the same for every reader."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tags, by the error that a reader, a cleaner or a search gives.
TAGS = {
    "network": "http", "timeout": "http", "blocked": "http", "reader_failed": "http", "unsupported_content_type": "http", "unsupported_encoding": "http", "too_many_redirects": "http",
    "blocked_address": "ssrf_blocked", "blocked_host": "ssrf_blocked", "bad_scheme": "bad_scheme", "blocked_port": "bad_port", "invalid_url": "invalid_url", "engine_failure": "engine_failure",
    "sanitization": "sanitization", "too_many_nodes": "sanitization", "rate_limited": "jina_rate_limited", "too_large": "response_too_large", "config": "config", "io": "io", "cache": "cache", "no_engines": "no_engines",
}


def tag(kind: Column) -> Column:
    """The tag of an error kind; null without an error, ``io`` for one that is not known."""
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in TAGS.items()))
    return F.when(kind.isNotNull(), F.coalesce(F.try_element_at(known, kind), F.lit("io")))
