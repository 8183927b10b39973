"""Addresses as a data source: ``spark.read.format("guarded_http")`` and ``spark.readStream`` of the same.

A request log is a folder of Parquet files in which requests lie by batch and
bucket (``append``).  A bucket has whole lanes.  A lane is a share of a host
(``per_host`` of them, by a hash of the address) or a key of a reader service,
and is asked by the one task that reads its bucket, one request at a time.  So
the bounds a host and a minute hold on any number of executors, without a
ledger that they share, and a host with most of the requests is spread over
``per_host`` tasks.

Planning lists folders and nothing else: a partition of the scan is a bucket of
a batch, and its task reads the requests itself.  ``host = ...`` and ``host IN
(...)`` prune buckets and requests before anything is asked
(``spark.sql.python.filterPushdown.enabled``).  The offset of a stream is the
number of whole batches; an offset that was planned is read again after a
failure, and every request gives one row either way.

Options: ``path``; ``per_host``, ``threads``, ``per_minute`` (of each lane), ``tries``,
``longest_wait``, ``max_bytes``, ``seconds``, ``proxy``, ``agent``; ``reader`` (address of a
reader service that the addresses are appended to) and ``keys`` (commas between);
``allow_private`` for tests.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..functions.urls import host_of
from . import lanes
from .http import Limits, Reply, read
from .reader import request_headers

SCHEMA = "request_id long, url string, host string, status int, content_type string, body binary, final_url string, etag string, last_modified string, error_kind string, tries int"


def lane_count(per_host: int, keys: list[str] | None) -> int:
    """Lanes of a host, or of the reader service."""
    return len(keys) if keys else max(1, per_host)


def append(requests: DataFrame, path: str, batch: int, buckets: int = 64, per_host: int = 2, by_host: bool = True, id_col: str = "request_id", url_col: str = "url") -> None:
    """Write requests as one batch of a log; a batch counts once it is whole, and writing it again replaces it.

    ``by_host`` is false for a reader service, whose lanes are its keys: pass their number as ``per_host``.
    """
    host = F.coalesce(host_of(F.col(url_col)), F.lit(""))
    lane = F.crc32(F.coalesce(F.col(url_col), F.lit("")).cast("binary")) % per_host
    d = requests.select(F.col(id_col).cast("long").alias("request_id"), F.col(url_col).alias("url"), host.alias("host"), lane.cast("int").alias("lane"))
    of = F.concat(F.col("host"), F.lit("#"), F.col("lane").cast("string")) if by_host else F.col("lane").cast("string")
    d = d.withColumn("bucket", (F.crc32(of.cast("binary")) % buckets).cast("int"))
    # within a bucket the lanes are mixed, so that a task looking ahead finds many
    d = d.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.xxhash64("url"), "request_id")
    d.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").partitionBy("buckets", "bucket").parquet(f"{path}/batch={batch:08d}")


@dataclass
class Bucket(InputPartition):
    """The files of a bucket of a batch."""

    paths: tuple[str, ...]
    hosts: tuple[str, ...] | None


class Log:
    """The whole batches of a request log, by any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(path if "://" in path else re.sub("^file:", "", path))

    def batches(self) -> list[int]:
        """Numbers of the whole batches, in order."""
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        own = [f for f in found if re.fullmatch(r"batch=\d+", f.base_name)]
        whole = self.fs.get_file_info([f"{f.path}/_SUCCESS" for f in own])
        return sorted(int(f.base_name[6:]) for f, s in zip(own, whole, strict=True) if s.type == pafs.FileType.File)

    def buckets(self, batch: int) -> dict[tuple[int, int], tuple[str, ...]]:
        """The files of each (bucket, number of buckets) of a batch."""
        out: dict[tuple[int, int], list[str]] = {}
        for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/batch={batch:08d}", recursive=True)):
            m = re.search(r"/buckets=(\d+)/bucket=(\d+)/[^/_.][^/]*\.parquet$", f.path)
            if m:
                out.setdefault((int(m[2]), int(m[1])), []).append(f.path)
        return {k: tuple(sorted(v)) for k, v in out.items()}


class Requests:
    """What the batch and the stream reader share: options, planning, reading a bucket."""

    def __init__(self, options: dict) -> None:
        o = {k.lower(): v for k, v in options.items()}
        self.path = o["path"]
        self.keys = [k for k in o.get("keys", "").split(",") if k]
        self.service = o.get("reader", "").rstrip("/")
        self.lanes = lane_count(int(o.get("per_host", 2)), self.keys if self.service else None)
        self.limits = Limits(int(o.get("max_bytes", 5 << 20)), float(o.get("seconds", 8)), allow_private=o.get("allow_private", "false") == "true", agent=o.get("agent", "pagefuse"), proxy=o.get("proxy"))
        self.policy = lanes.Policy(int(o.get("threads", 8)), int(o.get("per_minute", 20 if self.service else 0)), int(o.get("tries", 3)), float(o.get("longest_wait", 30)))
        self.hosts: set[str] | None = None

    def planned(self, batches: list[int]) -> list[Bucket]:
        """A partition for each bucket that may have a wanted host."""
        log, out = Log(self.path), []
        for b in batches:
            found = log.buckets(b)
            if self.hosts is not None and not self.service:
                named = [f"{h}#{lane}".encode() for h in self.hosts for lane in range(self.lanes)]
                found = {(k, n): v for (k, n), v in found.items() if any(zlib.crc32(x) % n == k for x in named)}
            out += [Bucket(files, None if self.hosts is None else tuple(sorted(self.hosts))) for _, files in sorted(found.items())]
        return out

    def ask(self, request: dict) -> Reply:
        """One read, of the address or of the reader service with the key of its lane."""
        url = request["url"]
        if not self.service:
            return read(url, self.limits)
        key = self.keys[request["lane"] % len(self.keys)] if self.keys else None
        return read(f"{self.service}/{url}", self.limits, request_headers(key))

    def rows(self, part: Bucket) -> Iterator[dict]:
        """The requests of a bucket, a few thousand at a time."""
        log = Log(self.path)
        for p in part.paths:
            with log.fs.open_input_file(p) as f:
                for b in pq.ParquetFile(f).iter_batches(4096):
                    for r in b.to_pylist():
                        if part.hosts is None or r["host"] in part.hosts:
                            yield r

    def read(self, part: Bucket | None) -> Iterator[pa.RecordBatch]:
        """A row for each request; bodies go on when they are 4 MB together."""
        if part is None:  # Spark's partition of a scan without any
            return
        held: list[tuple] = []
        size = 0
        lane = (lambda r: r["lane"]) if self.service else (lambda r: (r["host"], r["lane"]))
        for r, reply, tries in lanes.run(self.rows(part), lane, self.ask, self.policy):
            reply = lanes.named(reply, r["url"] or "")
            held.append((r["request_id"], r["url"], r["host"], reply.status, reply.content_type, reply.body, reply.final_url, reply.etag, reply.last_modified, reply.error_kind, tries))
            size += len(reply.body or b"")
            if size > 4 << 20 or len(held) >= 1000:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of ``SCHEMA``."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class BatchReader(Requests, DataSourceReader):
    """All whole batches of a log."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equalities of the host; the rest stay with Spark."""
        for f in filters:
            own = {f.value} if isinstance(f, EqualTo) and f.attribute == ("host",) else set(f.value) if isinstance(f, In) and f.attribute == ("host",) else None
            if own is None:
                yield f
            else:
                own.discard(None)
                self.hosts = own if self.hosts is None else self.hosts & own

    def partitions(self) -> list[Bucket]:
        """See ``Requests.planned``."""
        return self.planned(Log(self.path).batches())


class StreamReader(Requests, DataSourceStreamReader):
    """Batches of a log as they become whole; offsets name the last batch that was taken."""

    def initialOffset(self) -> dict:
        """Before all batches."""
        return {"batch": -1}

    def latestOffset(self) -> dict:
        """The last whole batch."""
        return {"batch": max(Log(self.path).batches(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        """The buckets of the batches after ``start``, up to ``end``."""
        return self.planned([b for b in Log(self.path).batches() if start["batch"] < b <= end["batch"]])

    def commit(self, end: dict) -> None:
        """Nothing to do: the log stays."""


class GuardedHttp(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        """The name of the format."""
        return "guarded_http"

    def schema(self) -> str:
        """A row for each request."""
        return SCHEMA

    def reader(self, schema: object) -> BatchReader:
        """For ``spark.read``."""
        return BatchReader(dict(self.options))

    def streamReader(self, schema: object) -> StreamReader:
        """For ``spark.readStream``."""
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take filters."""
    spark.dataSource.register(GuardedHttp)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
