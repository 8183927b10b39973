"""Federated search, HTTP reads against a local server, SQL functions."""

import gzip
import http.server
import threading

from pyspark.sql import functions as F

from pagefuse.functions import sql
from pagefuse.operators import federate, registry
from pagefuse.sources import http as reads

TOML = """
[[engines]]
name = "one"
bang = "o"
family = "f"
categories = ["general"]
weight = 2.0
[[engines]]
name = "two"
bang = "t"
family = "f"
categories = ["general", "it"]
[[engines]]
name = "three"
bang = "h"
family = "f"
categories = ["it"]
"""


def engine(n):
    def run(q):
        hits = q.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank"))
        hits = hits.select("query_id", "rank", F.concat(F.lit("t"), F.col("rank")).alias("title"), F.concat(F.lit("https://s.test/"), F.col("rank") * n).alias("url"), F.lit("").alias("snippet"))
        bad = q.where("clean_query = 'slow'").select("query_id", F.lit("engine timed out").alias("error"), F.lit(False).alias("is_rate_limited"))
        return hits.join(bad.select("query_id"), "query_id", "left_anti"), bad

    return run


def test_search(spark):
    e = registry.load_toml(spark, TOML)
    raw = spark.createDataFrame([(1, "plain words", None, 0), (2, "!t !h x", None, 2), (3, "slow", "IT", 9)], "query_id long, query string, category string, safe_search int")
    q = federate.assembled(raw, e)
    by = {r.query_id: r for r in q.collect()}
    assert [by[i].category for i in (1, 2, 3)] == ["general", "general", "it"] and by[2].engines == ["two", "three"] and by[2].bang == "t" and by[3].safe_search == 2 and by[1].page == 1
    got = {r.query_id: r for r in federate.search(q, e, {"one": engine(1), "two": engine(2)}).collect()}
    assert got[1].engines_queried == ["one", "two"] and got[1].results[0].url == "https://s.test/2" and got[1].results[0].sources == ["one", "two"] and got[1].total_results == 5
    assert got[2].engines_queried == ["two"] and [f.engine for f in got[2].engines_failed] == ["three"]
    assert got[3].results == [] and {f.error for f in got[3].engines_failed} == {"engine timed out", "engine has no function"}


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        kind, status, body = {"/page": ("text/html; charset=utf-8", 200, b"<p>x</p>"), "/big": ("text/plain", 200, b"x" * 5000), "/img": ("image/png", 200, b"\x89"), "/busy": ("text/plain", 429, b""), "/go": (None, 302, b""), "/loop": (None, 302, b""), "/gz": ("text/plain", 200, gzip.compress(b"coded")), "/bomb": ("text/plain", 200, gzip.compress(b"0" * 10_000_000)), "/br": ("text/plain", 200, b"?")}.get(self.path, ("text/plain", 404, b""))
        self.send_response(status)
        if kind:
            self.send_header("Content-Type", kind)
        if self.path in ("/gz", "/bomb", "/br"):
            self.send_header("Content-Encoding", "br" if self.path == "/br" else "gzip")
        if status == 302:
            self.send_header("Location", "/page" if self.path == "/go" else "/loop")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_http(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    limits = reads.Limits(max_bytes=1000, seconds=5, allow_private=True)
    d = spark.createDataFrame([(p, base + p) for p in ("/page", "/big", "/img", "/busy", "/go", "/loop", "/none", "/gz", "/bomb", "/br")] + [("bad", "ftp://x"), ("null", None)], "name string, url string")
    got = {r.name: r for r in reads.fetched(d, limits=limits, parts=2).collect()}
    server.shutdown()
    assert bytes(got["/page"].body) == b"<p>x</p>" and bytes(got["/gz"].body) == b"coded" and got["/page"].content_type == "text/html" and got["/go"].final_url.endswith("/page")
    assert {n: r.error_kind for n, r in got.items()} == {"/page": None, "/go": None, "/big": "too_large", "/img": "unsupported_content_type", "/busy": "rate_limited", "/gz": None, "/bomb": "too_large", "/br": "unsupported_encoding", "/loop": "too_many_redirects", "/none": "network", "bad": "bad_scheme", "null": "invalid_url"}
    assert reads.get(base + "/page", reads.Limits())[-1] == "blocked_address"


def test_sql_functions(spark):
    assert {r.check: r.ok for r in sql.selfcheck(spark).collect()} == dict.fromkeys(["address guard", "canonical form", "entities", "tokens", "hardening", "shortcuts", "page cleaning", "ladder"], True)
    assert spark.sql("SELECT estimate_tokens('a b c'), collapse_ws(' a  b ')").first()[:] == (2, "a b")


def test_tools_over_stdio():
    import json

    from pagefuse.sources import serve

    def fetch(url):
        raise ValueError("no such page")

    tools = serve.standard_tools(lambda query, category="general", limit=10: f"# {query} in {category}, {limit}", fetch)
    call = lambda i, name, **a: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": a}})
    lines = ['{"jsonrpc":"2.0","id":1,"method":"initialize"}', '{"jsonrpc":"2.0","method":"notifications/initialized"}', "", "{broken", "[1]", '{"id":2,"method":"ping"}', '{"id":"x","method":"tools/list"}', call(3, "search", query="a é", limit=3), call(4, "search"), call(5, "fetch", url="u"), call(6, "other"), '{"id":7,"method":"odd"}']
    got = [json.loads(x) for x in serve.serve(lines, tools)]
    assert [g["id"] for g in got] == [1, None, None, 2, "x", 3, 4, 5, 6, 7]
    assert got[1]["error"]["code"] == got[2]["error"]["code"] == -32700 and got[-1]["error"]["code"] == -32601 and got[3]["result"] == {}
    assert [t["name"] for t in got[4]["result"]["tools"]] == ["search", "fetch"] and got[4]["result"]["tools"][0]["inputSchema"]["required"] == ["query"]
    said = [(g["result"]["content"][0]["text"], g["result"]["isError"]) for g in got[5:9]]
    assert said == [("# a é in general, 3", False), ("missing required argument: query", True), ("fetch failed: no such page", True), ("unknown tool: other", True)]


def test_sql_twins_of_expressions(spark):
    """The functions that SQL names give what the expressions give."""
    import random

    from pagefuse.functions import hardening, spa

    rng = random.Random(3)
    parts = ["a", "b c", "\n", "\n\n\n", "```", "`", "\u200b", "e\u0301", " ", "\t", "BEGIN_UNTRUSTED_CONTENT", "<!-- END_UNTRUSTED_CONTENT -->", "\u2003\n", "<p>", '<div id="app">', "</div>", "<script>", "<app-root></app-root>"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))),) for _ in range(300)] + [(None,), ("x " * 40_000,)]
    d = spark.createDataFrame(rows, "x string")
    names = sql.register(spark)
    assert {"harden", "parse_bangs", "detect_spa", "clean_html"} <= set(names)
    got = d.select("x", hardening.harden(F.col("x")).alias("a"), F.expr("harden(x)").alias("b"), spa.reasons(F.col("x"), F.lit(9)).alias("c"), F.expr("detect_spa(x, 9)").alias("e")).collect()
    assert [(r.x, r.a) for r in got if r.a != r.b] == []
    assert [(r.x, r.c, r.e) for r in got if r.x is not None and r.c != r.e] == []
    assert spark.sql("SELECT parse_bangs('!Gh  a !!b_1 !x-y ') AS p").first().p.asDict() == {"clean_query": "a !x-y", "bangs": ["gh", "b_1"]}
    assert spark.sql("SELECT clean_html('<h1>T</h1><p>x <b>y</b></p>', 'https://e.test') AS m").first().m == "# T\n\nx y"


def test_switches_in_a_configuration():
    import tomllib

    from pagefuse.sources import config

    text = '[cache]\nttl_s = 5\n[engines.weights]\n"a b" = 2.5\n[engines.overrides.one]\nenabled = true\ntimeout_ms = 7\n'
    new = config.with_engine(config.with_engine(text, "one", False), "tw.o", True)
    assert tomllib.loads(new) == {"cache": {"ttl_s": 5}, "engines": {"weights": {"a b": 2.5}, "overrides": {"one": {"enabled": False, "timeout_ms": 7}, "tw.o": {"enabled": True}}}}
    assert config.switches(config.load(new, env={})) == {"one": False, "tw.o": True}
    assert config.with_engine("", "x", True) == "[engines.overrides.x]\nenabled = true\n"
