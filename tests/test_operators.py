"""Operators against small models in Python."""

import dataclasses
import json
import random

from pyspark.sql import functions as F

from pagefuse.functions import htmltree
from pagefuse.functions.text import estimate_tokens
from pagefuse.operators import cache, fuse, quota, registry, render
from pagefuse.sources import config, families, html_replies, json_replies, pages


def model_fuse(hits, weights, limit):
    """Row by row: what fusion must give."""
    out = {}
    for eo, rank, engine, title, url, snippet in sorted(hits, key=lambda h: (h[0], h[1])):
        key = url.replace("http://", "https://").replace("www.", "").rstrip("/") if url else "nourl:" + title
        r = out.setdefault(key, {"score": 0.0, "sources": [], "title": title, "snippet": snippet, "url": url, "seen": (eo, rank)})
        r["score"] += weights.get(engine, 1.0) / (60 + rank)
        if engine not in r["sources"]:
            r["sources"].append(engine)
        for k, v in (("title", title), ("snippet", snippet)):
            if len(v.encode()) > len(r[k].encode()):
                r[k] = v
    rows = sorted(out.values(), key=lambda r: (-int(r["score"] * 100 + 0.5) / 100, r["seen"]))[:limit]
    return [(r["url"], r["title"], r["snippet"], r["sources"]) for r in rows]


def test_fuse_model(spark):
    rng, rows, want = random.Random(1), [], {}
    weights = {"e0": 5.0, "e2": 0.5}
    for q in range(12):
        hits = []
        for eo in range(3):
            for rank in range(1, 30):
                n = rng.randint(0, 25)
                url = rng.choice([f"http://www.s{n}.test/", f"https://s{n}.test", None if n < 4 else f"https://s{n}.test"])
                hits.append((eo, rank, f"e{eo}", rng.choice(["aa", "bb", "é", f"t{n}"]) if url else f"t{n}", url, rng.choice(["", "s", "longer"])))
        want[q] = model_fuse(hits, weights, 10)
        rows += [(q, h[2], h[0], h[1], h[3], h[4], h[5]) for h in hits]
    d = spark.createDataFrame(rows, "query_id int, engine string, engine_ord int, rank int, title string, url string, snippet string")
    got = fuse.fuse(d, weights).orderBy("query_id", "rn").collect()
    for q, w in want.items():
        assert [(r.url, r.title, r.snippet, r.sources) for r in got if r.query_id == q] == w


def test_responses(spark):
    d = spark.createDataFrame([(1, "a", 0, 1, "t", "https://x.test", "s")], "query_id int, engine string, engine_ord int, rank int, title string, url string, snippet string")
    failed = spark.createDataFrame([(1, "a", "e", False), (1, "b", "timed out", False), (2, "b", "quota", True)], "query_id int, engine string, error string, is_rate_limited boolean")
    r = {x.query_id: x for x in fuse.responses(fuse.fuse(d), d.select("query_id", "engine"), failed).collect()}
    assert [f.engine for f in r[1].engines_failed] == ["b"] and r[1].total_results == 1
    assert r[2].results == [] and r[2].engines_failed[0].is_rate_limited


def test_registry(spark):
    e = registry.load_toml(spark, '[[engines]]\nname = "a"\nbang = "x"\nfamily = "f"\ncategories = ["it"]\n[[engines]]\nname = "b"\nbang = "x"\nfamily = "f"\ncategories = ["it"]\nweight = 3\n')
    assert [tuple(r) for r in registry.duplicates(e).collect()] == [("bang", "x", 2)]
    assert [r.name for r in registry.engines_for_category(e, "it").collect()] == ["b", "a"]
    over = registry.overlaid(e, spark.createDataFrame([("a", 9.0)], "name string, weight double"))
    assert {r.name: r.weight for r in over.collect()} == {"a": 9.0, "b": 3.0}


def test_admission_model(spark):
    rng = random.Random(2)
    calls = sorted((f"k{rng.randint(0, 3)}", rng.randint(0, 400), i) for i in range(600))
    d = spark.createDataFrame(calls, "key string, ts long, id long")
    got = {r.id: r.admitted for r in quota.admitted(d, limit=4, seconds=20).collect()}
    windows = {}
    for k, t, i in calls:
        w = windows[k] = [x for x in windows.get(k, []) if x >= t - 20]
        assert got[i] == (len(w) < 4)
        if got[i]:
            w.append(t)
    assert quota.pruned(d, 400, seconds=20).count() == sum(t >= 360 for _, t, _ in calls)


def test_window_edge(spark):
    d = spark.createDataFrame([("a", 0, 1), ("a", 60, 2), ("a", 61, 3)], "key string, ts long, id int")
    assert {r.id: r.in_window for r in quota.calls_in_window(d).collect()} == {1: 1, 2: 2, 3: 2}


def test_cache(spark):
    rows = spark.createDataFrame([("u", "old", 1), ("v", "x", 5)], "canonical_url string, markdown string, fetched_at long")
    new = spark.createDataFrame([("u", "new", 9)], "canonical_url string, markdown string, fetched_at long")
    assert {r.canonical_url: r.markdown for r in cache.upserted(rows, new).collect()} == {"u": "new", "v": "x"}
    ages = spark.createDataFrame([(7200,), (7201,), (14400,), (14401,), (None,)], "a long").select(cache.freshness(F.col("a"))).collect()
    assert [r[0] for r in ages] == ["fresh", "stale", "stale", "expired", None]


def test_page_render(spark):
    none = F.lit(None).cast("string")
    md = spark.range(1).select(render.page_markdown(F.lit("A [b]"), F.lit("u"), none, F.lit("2020"), none, F.lit("Cache"), F.lit(5), none, F.lit("body"))).first()[0]
    assert md == "# A \\[b\\]\n- **URL:** u\n- **Published:** 2020\n- **Method:** `Cache` | **Tokens:** ~5\n\nbody\n"
    j = json.loads(spark.range(1).select(render.page_json(F.struct(F.lit("t").alias("title"), none.alias("byline")))).first()[0])
    assert j == {"schema": "page.v1", "page": {"title": "t", "byline": None}}


def replies(spark, payload):
    return spark.createDataFrame([(1, "e", payload if isinstance(payload, str) else json.dumps(payload))], "query_id long, engine string, payload string")


def test_families(spark):
    rows = lambda df: [(r["title"], r["url"]) for r in df.orderBy("rank").collect()]
    d = replies(spark, {"query": {"search": [{"title": "A b", "snippet": "<i>x</i> &amp; y", "timestamp": "t"}, {"title": ""}]}})
    got = families.mediawiki(d, "w.test").collect()
    assert len(got) == 1 and got[0].url == "https://w.test/wiki/A_b" and got[0].snippet == "x & y"
    d = replies(spark, {"items": [{"title": "Q &lt;", "link": "l", "score": 3, "is_answered": True, "creation_date": 86400}]})
    assert families.stackexchange(d).first().metadata == {"score": "3", "answers": "0", "answered": "true"} and families.stackexchange(d).first().published_date == "1970-01-02"
    d = replies(spark, {"posts": [{"topic_id": 9, "blurb": "gone"}, {"topic_id": 1, "blurb": "b"}, {"topic_id": 1, "blurb": "c"}], "topics": [{"id": 1, "title": "T", "slug": "s"}]})
    assert rows(families.discourse(d, "https://f.test")) == [("T", "https://f.test/t/s/1")]
    d = replies(spark, {"posts": [{"post": {"name": "n", "id": 4}, "community": {"name": "c"}}, {"post": {"name": "x"}}]})
    assert rows(families.lemmy(d, "posts", "https://l.test")) == [("n", "https://l.test/post/4")]
    d = replies(spark, {"communities": [{"community": {"name": "c", "title": "T"}}], "users": [{"person": {"name": "u"}}], "comments": [{"comment": {"id": 3, "content": "<p>hi</p>"}}]})
    assert rows(families.lemmy(d, "communities", "b")) == [("T (c)", "b/c/c")] and rows(families.lemmy(d, "users", "b")) == [("u (@u)", "b/u/u")] and rows(families.lemmy(d, "comments", "b")) == [("Comment #3", "b/comment/3")]
    d = replies(spark, {"hashtags": [{"name": "x", "history": [{"uses": "7"}]}], "accounts": [{"username": "u", "url": "l"}, {"username": "v"}]})
    assert rows(families.mastodon(d, True, "b")) == [("#x", "b/tags/x")] and rows(families.mastodon(d, False, "b")) == [("u (@u)", "l")]
    d = replies(spark, {"query": {"pages": {"2": {"title": "File:B", "imageinfo": [{"descriptionurl": "d2", "thumburl": "t"}]}, "1": {"title": "File:A", "imageinfo": [{"descriptionurl": "d1"}]}, "3": {"title": "no"}}}})
    assert rows(families.commons(d)) == [("A", "d1"), ("B", "d2")]
    t = {"FirstURL": "u", "Text": "Name - about"}
    d = replies(spark, {"Heading": "H", "AbstractURL": "a", "AbstractText": "x", "AbstractSource": "S", "RelatedTopics": [t, {"Topics": [t] * 9}] + [t] * 20})
    got = families.instant_answers(d).orderBy("rank").collect()
    assert [len(got), got[0].snippet, got[1].title] == [12, "x (via S)", "Name"]
    d = replies(spark, {"status": "success", "data": {"result": {"items": {"mainline": [{"type": "ads", "items": [{"title": "ad", "url": "x"}]}, {"type": "web", "items": [{"title": f"t{i}", "url": f"u{i}"} for i in range(20)]}, {"type": "web", "items": [{"title": "z", "url": "y"}, {"title": "z2", "url": "y2"}]}]}}}})
    got = rows(families.qwant(d, "web"))
    assert len(got) == 16 and got[-1] == ("z", "y")
    s = replies(spark, {"result": {"7": {"title": "T", "source": "J", "pubdate": "2020", "authors": [{"name": n} for n in "abcd"]}, "5": {"title": "U"}}})
    got = families.pubmed(replies(spark, {"esearchresult": {"idlist": ["7", "6", "5"]}}), s).orderBy("rank").collect()
    assert [(r.title, r.snippet) for r in got] == [("T", "J · a, b, c, et al. · 2020"), ("U", " · … · ")]
    d = replies(spark, [{"display_name": "P", "osm_type": "way", "osm_id": 3, "lat": "1", "lon": "2"}, {"display_name": "Q", "osm_id": 0}])
    assert rows(families.nominatim(d)) == [("P", "https://www.openstreetmap.org/way/3")]
    d = replies(spark, {"features": [{"properties": {"name": "P", "osm_id": 3, "osm_type": "R", "city": "C", "country": "D"}}]})
    assert families.photon(d).first().snippet == "C, D"
    d = replies(spark, [{"title": "n", "url": "u", "date": 0, "source": "s"}, {"title": "m", "url": "v", "relative_time": "1 hour ago"}])
    assert [r.published_date for r in families.news(d).orderBy("rank").collect()] == ["1970-01-01", "1 hour ago"]
    assert rows(families.model_hub(replies(spark, [{"id": "a/b", "likes": 2}]))) == [("a/b", "https://huggingface.co/a/b")]


def test_specs_extract(spark):
    """Every declarative spec fills title and URL from an item of its own shape."""
    for name, s in json_replies.SPECS.items():
        item: dict = {}
        for f in (s.title, s.url):
            at = item
            *path, last = f.path.split(".")
            for k, nxt in zip(path, [*path[1:], last], strict=False):
                at = at.setdefault(k, [{}] if nxt.isdigit() else {})
            if isinstance(at, list):
                at[0] = "v"
            else:
                at[last] = "v"
        payload: object = [item]
        for k in reversed(s.results.split(".") if s.results else []):
            payload = {k: payload}
        got = json_replies.extract(replies(spark, payload), s).collect()
        assert [(r.title, r.url) for r in got] == [("v", s.url.prefix + "v")], name
    assert json_replies.parse_failures(replies(spark, {"x": 1}), json_replies.SPECS["wiby"]).count() == 1


def test_instant_joins(spark):
    q = spark.createDataFrame([(1, "10 usd to eur"), (2, "how are you 5")], "query_id long, query string")
    rates = spark.createDataFrame([("USD", 1.0), ("EUR", 0.5)], "code string, per_unit double")
    assert [(r.query_id, r.title) for r in families.currency(q, rates).collect()] == [(1, "10.0000 USD = 5.0000 EUR")]
    d = spark.createDataFrame([("guten Tag", "de", "en", "good day")], "text string, `from` string, `to` string, translation string")
    q = spark.createDataFrame([(1, "de en guten Tag")], "query_id long, query string")
    assert families.translations(q, d).first().title == "good day"


def test_html_replies():
    html = '<div class="result"><a class="result__a" href="/l/?uddg=https%3A%2F%2Fx.test%2Fa">A  b</a><a class="result__snippet">S</a></div><div class="result result--ad"><a class="result__a" href="https://ad.test">ad</a></div>'
    assert html_replies.rows_of(html, html_replies.SPECS["duckduckgo"]) == [(1, "A b", "https://x.test/a", "S", None, {})]
    html = '<a class="package-snippet" href="/project/x/"><span class="package-snippet__name">x</span><span class="package-snippet__version">1</span><p class="package-snippet__description">d</p></a><a class="package-snippet"></a>'
    assert html_replies.rows_of(html, html_replies.SPECS["pypi"]) == [(1, "x", "https://pypi.org/project/x/", "d", None, {"version": "1"})]


def test_capped_pages_are_parsed_as_far_as_needed(monkeypatch):
    row = '<div class="snippet" data-type="web"><a href="https://h.test/{0}"><span class="title">T &amp; {0}</span></a><p class="snippet-description">s\n {0}</p></div>'
    page = "<html><body>" + "\n".join(row.format(k) for k in range(5000)) + "</body></html>"
    fed = []
    feed = htmltree._Builder.feed
    monkeypatch.setattr(htmltree._Builder, "feed", lambda b, x: (fed.append(len(x)), feed(b, x))[1])
    spec = html_replies.SPECS["brave"]
    got = html_replies.rows_of(page, spec)
    assert got == [(k + 1, f"T & {k}", f"https://h.test/{k}", f"s {k}", None, {}) for k in range(15)] and sum(fed) < 10_000
    # an item that stays open takes the rest of the page, so it counts only once that is read
    late = '<div class="result"><a href="https://x.test/">A</a><h2>t</h2>' + "<i>x</i>" * 2000 + '<p class="description">last</p></div>' + "<p>y</p>" * 2000
    for html in (page[:3000], late):
        every = html_replies.rows_of(html, dataclasses.replace(html_replies.SPECS["startpage"], cap=None))
        assert html_replies.rows_of(html, html_replies.SPECS["startpage"]) == every[:15]
    assert html_replies.rows_of(late, html_replies.SPECS["startpage"])[0][3] == "last"


def test_replay(spark):
    rows = [("http://e.test/a", "<html></html>", "text/html", 200), ("http://10.0.0.1/", "x", None, 200), ("http://e.test/b", "x", "image/png", 200), ("http://e.test/c", "{}", None, 429), ("http://e.test/d", "x" * 50, "text/plain", 200)]
    d = pages.replay(spark.createDataFrame(rows, "url string, html string, ct string, status int"), type_col="ct", status_col="status", max_bytes=20)
    assert [r.error_kind for r in d.collect()] == [None, "blocked_address", "unsupported_content_type", "rate_limited", "too_large"]


def test_config():
    c = config.load("[cache]\nttl_s = 5\n", env={"PAGEFUSE_CACHE__ENABLED": "false", "PAGEFUSE_HTTP__TOTAL_MS": "9"})
    assert config.get(c, "cache.ttl_s") == 5 and config.get(c, "cache.enabled") is False and config.get(c, "http.total_ms") == 9 and config.get(c, "cache.stale_multiplier") == 2
    assert config.get(c, "no.such") is None


def test_tokens_grow(spark):
    d = spark.createDataFrame([("",), ("a b",), ("a b c d e f",)], "x string").select(estimate_tokens(F.col("x")).alias("n")).collect()
    assert [r.n for r in d] == sorted(r.n for r in d) and d[0].n == 0
