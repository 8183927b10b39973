"""The bucketed cache: what it returns, what a look-up moves and what a merge touches."""

import os

import pytest
from pyspark.sql import functions as F

from pagefuse.operators import cache
from pagefuse.operators.cache_table import POINTS, CacheTable

SCHEMA = "canonical_url string, markdown string, fetched_at long"


@pytest.fixture
def table(spark, tmp_path):
    return CacheTable(spark, str(tmp_path / "cache"), SCHEMA, "cache_test", buckets=8, levels=3)


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(table):
    return {r.canonical_url: (r.markdown, r.fetched_at) for r in table.pages().collect()}


def stamps(path):
    """All data files with their time of change."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/pages") for f in names if f.endswith(".parquet")}


def test_merges_equal_upserts(spark, table):
    want = pages(spark, [])
    for g in range(7):
        new = pages(spark, [(f"u{k}", f"{g}", 10 + (g * 7 + k) % 11) for k in range(g, g + 30)] + [(None, "x", 1), (f"u{g}", "twice", 99 - g)])
        table.merge(new)
        want = cache.upserted(want, new.where("canonical_url IS NOT NULL"))
    assert table.generations() == list(range(7))
    assert held(table) == {r.canonical_url: (r.markdown, r.fetched_at) for r in want.collect()}
    again = CacheTable(spark, table.path, SCHEMA, "cache_again", buckets=8)  # another session finds it all
    assert held(again) == held(table)


def test_a_merge_touches_its_buckets_only(spark, table):
    base = [(f"u{k}", "a", 1) for k in range(200)]
    table.merge(pages(spark, base))
    of = {r[0]: r[1] for r in pages(spark, base).select("canonical_url", table.bucket(F.col("canonical_url"))).collect()}
    one = [u for u in of if of[u] == of["u0"]][:3]
    before = stamps(table.path)
    for g in range(5):
        table.merge(pages(spark, [(u, f"g{g}", 10 + g) for u in one]))
    after = stamps(table.path)
    gone = [f for f in before if f not in after]
    assert gone and all(f"_{of['u0']:05d}." in f for f in gone)  # that bucket was rewritten, its old file went
    assert all(after[f] == before[f] for f in before if f not in gone)
    assert all(f"_{of['u0']:05d}." in f for f in after if f not in before)
    assert sum(len(table.files(g).get(of["u0"], [])) for g in table.generations()) <= 3
    assert held(table) == {u: ("g4", 14) if u in one else ("a", 1) for u in of}


def test_a_killed_merge_is_invisible(spark, table, monkeypatch):
    table.merge(pages(spark, [("u", "a", 1), ("v", "a", 1)]))

    def killed(number):
        raise RuntimeError("killed")

    monkeypatch.setattr(table, "commit", killed)
    with pytest.raises(RuntimeError):
        table.merge(pages(spark, [("u", "half", 9)]))
    monkeypatch.undo()
    assert held(table) == {"u": ("a", 1), "v": ("a", 1)} and table.generations() == [0]
    assert table.merge(pages(spark, [("v", "b", 5)])) == 1  # takes the number, and the place, of the killed one
    assert held(table) == {"u": ("a", 1), "v": ("b", 5)}
    table.writer(pages(spark, [("v", "c", 6)]), 1)  # a batch that is there already
    assert held(table)["v"] == ("b", 5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below(text, name):
    """The lines of a plan from a scan of a table up to the join, without those of the other side."""
    lines = text.split("\n")
    at = next(i for i, x in enumerate(lines) if name in x and "Scan" in x)
    depth, out = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for x in reversed(lines[: at + 1]):
        own = len(x) - len(x.lstrip(" :+-*0123456789()"))
        if own <= depth:
            out.append(x)
            depth = own
        if "Join" in x:
            break
    return "\n".join(out)


def test_look_ups_do_not_move_the_cache(spark, table):
    table.merge(pages(spark, [(f"u{k}", "a", 100 + k % 50) for k in range(1000)]))
    table.merge(pages(spark, [(f"u{k}", "b", 200) for k in range(0, 1000, 9)]))
    many = spark.range(1500).select(F.concat(F.lit("u"), F.col("id")).alias("canonical_url"), (F.col("id") % 2 == 0).alias("failed"))
    got = table.looked_up(many, F.lit(210), ttl=60, failed="failed")
    text = plan(got)
    assert "SortMergeJoin" in text and "Exchange" not in below(text, "cache_test") and text.count("Exchange hashpartitioning") == 1
    want = cache.looked_up(many, table.pages(), F.lit(210), ttl=60, failed="failed")
    key = lambda r: (r.canonical_url, str(r.cache_state), r.action, str(r.cached_markdown))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    few = many.where("canonical_url IN ('u9', 'u10', 'u1400')")
    got = table.looked_up(few, F.lit(210), ttl=60, failed="failed")
    text = got._jdf.queryExecution().toString()
    assert "SelectedBucketsCount: " in text and "SelectedBucketsCount: 8 out of 8" not in text
    assert "In(canonical_url" in text and few.count() < POINTS
    assert {r.canonical_url: r.action for r in got.collect()} == {"u9": "cache", "u10": "cache_stale", "u1400": "error"}
