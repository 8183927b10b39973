"""Reads by lanes, and the request log as a data source, against a server on this machine."""

import gzip
import http.server
import threading
import time
from collections import Counter, defaultdict

import pytest
import zstandard

from pagefuse.sources import http as reads
from pagefuse.sources import lanes, requests
from pagefuse.sources.http import Reply


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        self.now += s


def test_lanes_and_minutes():
    """A lane is asked once at a time and so often a minute, whatever the others do; each request ends once."""
    clock, calls, open_, worst = Clock(), defaultdict(list), Counter(), Counter()

    def read(r):
        lane = r % 3
        open_[lane] += 1
        worst[lane] = max(worst[lane], open_[lane])
        calls[lane].append(clock.now)
        time.sleep(0.001)
        open_[lane] -= 1
        return Reply(str(r))

    got = list(lanes.run(range(45), lambda r: r % 3, read, lanes.Policy(threads=8, per_minute=5, held=20), clock=clock, sleep=clock.sleep))
    assert sorted(r for r, _, _ in got) == list(range(45)) and all(w == 1 for w in worst.values())
    for times in calls.values():
        assert all(sum(t - 60 < x <= t for x in times) <= 5 for t in times)


def test_tries_and_pauses():
    clock, seen = Clock(), Counter()

    def read(r):
        seen[r] += 1
        if r == "busy" and seen[r] < 3:
            return Reply(r, "rate_limited", 429, retry_after=7)
        if r == "long":
            return Reply(r, "rate_limited", 429, retry_after=900)
        return Reply(r, "timeout" if r == "dead" else "blocked_address" if r == "bad" else None)

    got = {r: (reply.error_kind, tries) for r, reply, tries in lanes.run(["busy", "dead", "bad", "long", "ok"], lambda r: r, read, lanes.Policy(tries=3), clock=clock, sleep=clock.sleep)}
    assert got == {"busy": (None, 3), "dead": ("timeout", 3), "bad": ("blocked_address", 1), "long": ("rate_limited", 1), "ok": (None, 1)}
    assert clock.now >= 14


def test_deadline():
    def read(r):
        time.sleep(0.01 if r == "fast" else 3)
        return Reply(r)

    began = time.monotonic()
    got = {r: reply.error_kind for r, reply, _ in lanes.run(["fast", "slow", "late"], lambda r: r, read, lanes.Policy(threads=2), deadline=began + 0.4)}
    assert got == {"fast": None, "slow": "deadline", "late": "deadline"} and time.monotonic() - began < 2


class Site(http.server.BaseHTTPRequestHandler):
    open_, most, seen, lock = Counter(), Counter(), defaultdict(list), threading.Lock()

    def do_GET(self):
        host = self.headers["Host"].split(":")[0]
        key = self.headers.get("Authorization", "")
        with Site.lock:
            Site.open_[host] += 1
            Site.most[host] = max(Site.most[host], Site.open_[host])
            Site.seen[self.path].append((host, key, time.monotonic()))
            count = len(Site.seen[self.path])
        time.sleep(0.02)
        with Site.lock:
            Site.open_[host] -= 1
        if self.path == "/busy" and count < 2:
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        body = {"/zstd": zstandard.compress(b"coded"), "/zbomb": zstandard.compress(b"0" * (1 << 27)), "/bomb": gzip.compress(b"0" * (1 << 25))}.get(self.path, self.path.encode())
        self.send_response(200)
        self.send_header("Content-Type", "text/plain")
        self.send_header("ETag", '"v1"')
        if self.path in ("/zstd", "/zbomb", "/bomb"):
            self.send_header("Content-Encoding", "gzip" if self.path == "/bomb" else "zstd")
        self.end_headers()
        try:
            self.wfile.write(body)
        except OSError:
            pass

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    for c in (Site.open_, Site.most, Site.seen):
        c.clear()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_port
    server.shutdown()


def test_bodies_stop_at_the_cap(site):
    limits = reads.Limits(max_bytes=100_000, allow_private=True)
    base = f"http://127.0.0.1:{site}"
    assert reads.read(base + "/zstd", limits).body == b"coded" and reads.read(base + "/zstd", limits).etag == '"v1"'
    assert reads.read(base + "/zbomb", limits).error_kind == reads.read(base + "/bomb", limits).error_kind == "too_large"
    coded = type("Source", (), {"left": [zstandard.compress(b"0" * (1 << 27))], "read": lambda self, n=-1: self.left.pop() if self.left else b""})()
    assert len(reads.plain_body(coded, "zstd", 5000)) == 5001
    through = reads.Limits(allow_private=True, proxy=base)
    assert reads.read("http://localhost:1234/x", through).body == b"http://localhost:1234/x"


def log(spark, path, port, batch, names, **kw):
    rows = [(100 * batch + k, n if n is None or "://" in n else f"http://{n.split('/')[0]}:{port}/{n.split('/')[1]}") for k, n in enumerate(names)]
    requests.append(spark.createDataFrame(rows, "request_id long, url string"), path, batch, **kw)


def source(stream, path, **options):
    made = stream.format("guarded_http").option("path", path).option("allow_private", "true")
    for k, v in options.items():
        made = made.option(k, v)
    return made.load()


def test_log_as_batches(spark, site, tmp_path):
    requests.register(spark)
    path = str(tmp_path / "log")
    log(spark, path, site, 0, [f"127.0.0.1/a{k}" for k in range(40)] + ["localhost/b", "localhost/busy", "ftp://x/y", None], buckets=4, per_host=2)
    got = {r.request_id: r for r in source(spark.read, path, per_host=2, first_wait=0).collect()}
    assert len(got) == 44 and bytes(got[3].body) == b"/a3" and got[3].etag == '"v1"' and got[3].tries == 1
    assert got[41].tries == 2 and got[41].error_kind is None
    assert got[42].error_kind == "bad_scheme" and got[43].error_kind == "invalid_url" and got[43].url is None
    assert Site.most["127.0.0.1"] <= 2  # two lanes, each in one task
    Site.seen.clear()
    own = source(spark.read, path, per_host=2).where("host = 'localhost' AND error_kind IS NULL")
    assert {r.request_id for r in own.collect()} == {40, 41}
    assert not any(p.startswith("/a") for p in Site.seen)  # pruned before anything was asked
    assert source(spark.read, str(tmp_path / "none")).count() == 0


def test_log_as_stream(spark, site, tmp_path):
    requests.register(spark)
    path = str(tmp_path / "log")

    def go():
        q = source(spark.readStream, path).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.request_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    log(spark, path, site, 0, ["127.0.0.1/a", "127.0.0.1/b"], buckets=2)
    log(spark, path, site, 1, ["127.0.0.1/c"], buckets=2)
    assert go() == [0, 1, 100]
    log(spark, path, site, 2, ["localhost/d"], buckets=2)
    assert go() == [0, 1, 100, 200] and len(Site.seen["/a"]) == 1


def test_reader_service_with_keys(spark, site, tmp_path):
    """Each key is asked in one lane and with its own header."""
    requests.register(spark)
    path = str(tmp_path / "log")
    names = [f"https://e.test/{k}" for k in range(12)]
    log(spark, path, site, 0, names, buckets=8, per_host=2, by_host=False)
    got = source(spark.read, path, reader=f"http://127.0.0.1:{site}", keys="k1,k2").collect()
    assert {bytes(r.body).decode() for r in got} == {f"/{n}" for n in names}
    assert {key for calls in Site.seen.values() for _, key, _ in calls} == {"Bearer k1", "Bearer k2"} and Site.most["127.0.0.1"] <= 2
