"""One query to many engines: timeouts, a deadline, and what the others answered."""

import http.server
import json
import threading
import time

from pyspark.sql import functions as F

from pagefuse.operators import fuse
from pagefuse.sources import fanout, json_replies
from pagefuse.sources.http import Limits, Reply


def test_each_timeout_and_one_deadline():
    def ask(url, left):
        time.sleep(float(url))
        return Reply(url)

    queries = [(k, [("fast", "0.01", None), ("slow", "1.5", 100), ("late", "1.5", 60_000), ("mid", "0.15", 1000)]) for k in range(6)]
    began = time.monotonic()
    got = list(fanout.answers(iter(queries), ask, 0.4, at_once=3))
    assert time.monotonic() - began < 2  # two rounds of the deadline, not six, and no wait for the late
    assert {(q, e): r.error_kind for q, e, r, _ in got} == {(q, e): x for q in range(6) for e, x in (("fast", None), ("slow", fanout.TIMED_OUT), ("late", fanout.TIMED_OUT), ("mid", None))}
    took = {e: s for q, e, _, s in got if q == 0}
    assert 0.1 <= took["slow"] < 0.35 and 0.4 <= took["late"] < 0.8 and len(got) == 24


def test_queries_are_gathered_over_batches():
    import pyarrow as pa

    b = [pa.RecordBatch.from_pylist([{"query_id": q, "engine": e, "url": None, "timeout_ms": None} for q, e in rows]) for rows in ([(1, "a"), (1, "b"), (2, "a")], [(2, "b")], [(3, "a"), (None, "a")])]
    assert [(q, [x[0] for x in own]) for q, own in fanout.grouped(iter(b))] == [(1, ["a", "b"]), (2, ["a", "b"]), (3, ["a"]), (None, ["a"])]


class Engines(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path.startswith("/slow"):
            time.sleep(2)
        self.send_response(429 if self.path.startswith("/busy") else 200)
        self.send_header("Content-Type", "application/json")
        self.end_headers()
        try:
            self.wfile.write(json.dumps([{"t": f"page {k}", "u": f"https://e.test/{k}"} for k in range(3)]).encode())
        except OSError:
            pass

    def log_message(self, *args):
        pass


def test_search_over_http(spark):
    """Replies of the engines that answer are fused; those that don't are failures of the response."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Engines)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = [(q, e, f"http://127.0.0.1:{server.server_port}/{e}?q={q}", t) for q in (1, 2) for e, t in (("good", None), ("also", 5000), ("slow", 300), ("busy", None))] + [(2, "bad", "file:///x", None), (3, "none", None, None)]
    d = spark.createDataFrame(rows, "query_id long, engine string, url string, timeout_ms int")
    path = fanout.fan_out(d, 1.5, Limits(allow_private=True)).collect()
    server.shutdown()
    replies = spark.createDataFrame(path, fanout.SCHEMA)
    assert {(r.query_id, r.engine): r.error for r in path} == {(q, e): x for q in (1, 2) for e, x in (("good", None), ("also", None), ("slow", fanout.TIMED_OUT), ("busy", "rate_limited"))} | {(2, "bad"): "bad_scheme", (3, "none"): "invalid_url"}
    f = json_replies.Field
    hits = json_replies.extract(replies.where("error IS NULL").withColumn("payload", F.col("body").cast("string")), json_replies.Spec(None, f("t"), f("u"))).withColumn("engine_ord", (F.col("engine") == "also").cast("int"))
    got = {r.query_id: r for r in fuse.responses(fuse.fuse(hits), hits.select("query_id", "engine").distinct(), fanout.failures(replies)).collect()}
    assert got[1].total_results == 3 and got[1].engines_queried == ["also", "good"] and {(x.engine, x.is_rate_limited) for x in got[1].engines_failed} == {("slow", False), ("busy", True)}
    assert got[3].total_results == 0 and [x.error for x in got[3].engines_failed] == ["invalid_url"]
