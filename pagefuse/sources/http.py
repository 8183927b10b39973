"""Capped, guarded HTTP reads for a table of addresses.

Each row is one GET: the address and every redirect are checked before the
connection, every resolved address must be public, the content type is judged
before the body is read, and reading stops at the byte cap.  Errors are rows.
"""

from __future__ import annotations

import http.client
import socket
import ssl
import urllib.parse
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.urls import BAD_PORTS, address_blocked

SCHEMA = "status int, content_type string, body binary, final_url string, error_kind string"
#: Prefixes and parts of content types that the readers take.
_READABLE = ("text/", "application/json", "application/xml", "application/xhtml+xml", "application/ndjson", "application/x-ndjson", "application/javascript", "application/typescript", "application/csv")


@dataclass(frozen=True)
class Limits:
    """Bounds of a read; ``allow_private`` is for tests against a local server, ``proxy`` an http address that all reads go through."""

    max_bytes: int = 5 * 1024 * 1024
    seconds: float = 8.0
    redirects: int = 5
    allow_private: bool = False
    agent: str = "pagefuse"
    proxy: str | None = None


@dataclass(frozen=True)
class Reply:
    """What came of one GET; ``error_kind`` is null for a body that was read."""

    final_url: str
    error_kind: str | None = None
    status: int | None = None
    content_type: str | None = None
    body: bytes | None = None
    etag: str | None = None
    last_modified: str | None = None
    retry_after: int | None = None


def plain_body(source: http.client.HTTPResponse, encoding: str | None, most: int) -> bytes | None:
    """The body as plain bytes, at most one more than ``most`` of them whatever it expands to; null for unknown codings."""
    name = (encoding or "identity").strip().lower()
    if name == "identity":
        return source.read(most + 1)
    if name == "zstd":
        with zstandard.ZstdDecompressor(max_window_size=1 << 23).stream_reader(source, read_across_frames=True) as z:
            out = bytearray()
            while len(out) <= most and (part := z.read(min(1 << 16, most + 1 - len(out)))):
                out += part
            return bytes(out)
    if name not in ("gzip", "x-gzip", "deflate"):
        return None
    z, out = zlib.decompressobj(zlib.MAX_WBITS | 32), bytearray()
    while len(out) <= most and not z.eof and (chunk := source.read(1 << 16)):
        while chunk and len(out) <= most and not z.eof:
            out += z.decompress(chunk, min(1 << 20, most + 1 - len(out)))
            chunk = z.unconsumed_tail
    return bytes(out)


def connected(p: urllib.parse.SplitResult, limits: Limits) -> tuple[http.client.HTTPConnection, str] | str:
    """(open connection, request target) of an address that may be read, or why it may not.

    With a proxy the proxy looks names up; what they resolve to here is judged all the same.
    """
    if p.scheme and p.scheme not in ("http", "https"):
        return "bad_scheme"
    if not p.scheme or not p.hostname:
        return "invalid_url"
    port = p.port or (443 if p.scheme == "https" else 80)
    if port in BAD_PORTS:
        return "blocked_port"
    host = p.hostname.rstrip(".")
    found = {x[4][0] for x in socket.getaddrinfo(p.hostname, port, type=socket.SOCK_STREAM)}
    if not limits.allow_private and (host == "localhost" or host.endswith(".localhost") or any(map(address_blocked, found))):
        return "blocked_address"
    path = urllib.parse.urlunsplit(("", "", p.path or "/", p.query, ""))
    if limits.proxy:
        via = urllib.parse.urlsplit(limits.proxy)
        con = http.client.HTTPConnection(via.hostname, via.port or 80, timeout=limits.seconds)
        if p.scheme == "https":
            con.set_tunnel(p.hostname, port)
        else:
            path = urllib.parse.urlunsplit((p.scheme, p.netloc.rpartition("@")[2], p.path or "/", p.query, ""))
    else:
        con = http.client.HTTPConnection(sorted(found)[0], port, timeout=limits.seconds)  # connect to what was checked, so a second look-up can't differ
    con.connect()
    if p.scheme == "https":
        con.sock = ssl.create_default_context().wrap_socket(con.sock, server_hostname=p.hostname)
    return con, path


def read(url: str | None, limits: Limits, headers: dict[str, str] | None = None) -> Reply:
    """One guarded GET."""
    at = url or ""
    try:
        for _ in range(limits.redirects + 1):
            p = urllib.parse.urlsplit(at)
            opened = connected(p, limits)
            if isinstance(opened, str):
                return Reply(at, opened)
            con, path = opened
            try:
                own = {"Host": p.netloc.rpartition("@")[2], "User-Agent": limits.agent, "Accept": "text/html,application/json,text/*;q=0.8", "Accept-Encoding": "gzip, deflate, zstd", "Connection": "close"}
                con.request("GET", path, headers=own | (headers or {}))
                r = con.getresponse()
                if r.status in (301, 302, 303, 307, 308) and r.getheader("Location"):
                    at = urllib.parse.urljoin(at, r.getheader("Location"))
                    if urllib.parse.urlsplit(at).netloc != p.netloc:
                        headers = None  # keys are for the host that was asked
                    continue
                kind = (r.getheader("Content-Type") or "").split(";")[0].strip().lower() or None
                wait = (r.getheader("Retry-After") or "").strip()
                told = {"status": r.status, "content_type": kind, "etag": r.getheader("ETag"), "last_modified": r.getheader("Last-Modified"), "retry_after": int(wait) if wait.isdecimal() else None}
                error = {429: "rate_limited", 403: "blocked"}.get(r.status) or (None if 200 <= r.status < 300 else "network")
                if not error and kind and not (kind.startswith(_READABLE) or kind.endswith(("+json", "+xml", "yaml", "yml", "markdown"))):
                    error = "unsupported_content_type"
                if error:
                    return Reply(at, error, **told)
                body = plain_body(r, r.getheader("Content-Encoding"), limits.max_bytes)
                if body is None or len(body) > limits.max_bytes:
                    return Reply(at, "unsupported_encoding" if body is None else "too_large", **told)
                return Reply(at, None, body=body, **told)
            finally:
                con.close()
        return Reply(at, "too_many_redirects")
    except TimeoutError:
        return Reply(at, "timeout")
    except (OSError, http.client.HTTPException, ValueError, zlib.error, zstandard.ZstdError):
        return Reply(at, "network")


def get(url: str | None, limits: Limits) -> tuple:
    """The fields of ``SCHEMA`` for one address."""
    r = read(url, limits)
    return r.status, r.content_type, r.body, r.final_url, r.error_kind


def fetched(urls: DataFrame, url_col: str = "url", limits: Limits = Limits(), parts: int | None = None, getter: Callable[[str | None, Limits], tuple] = get) -> DataFrame:
    """``urls`` with the fields of ``SCHEMA``; ``parts`` bounds how many reads run at a time."""
    src = urls.repartition(parts, url_col) if parts else urls
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    schema = StructType([*src.schema.fields, *StructType.fromDDL(SCHEMA).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 16):  # bodies of a few rows at a time
                part = b.iloc[k : k + 16].reset_index(drop=True)
                rows = pd.DataFrame([getter(u, limits) for u in part[url_col]], columns=names)
                rows["status"] = rows["status"].astype("Int32")
                yield pd.concat([part, rows], axis=1)

    return src.mapInPandas(run, schema)


def failures(pages: DataFrame, id_col: str, engine_col: str) -> DataFrame:
    """Reads that failed, as engine failures."""
    return pages.where("error_kind IS NOT NULL").select(id_col, F.col(engine_col).alias("engine"), F.col("error_kind").alias("error"), (F.col("error_kind") == "rate_limited").alias("is_rate_limited"))
