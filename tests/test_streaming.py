"""Streaming forms against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from pagefuse.operators import quota
from pagefuse.streaming import admission, limits, stale


def run(stream, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    spark.streams_run = q
    return spark.table(name)


def source(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/events.parquet").where("user_id < 20")
    d.select(F.col("user_id").cast("string").alias("key"), F.floor(F.unix_timestamp("ts") / 600).cast("long").alias("ts"), "event_id", F.col("ts").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), spark.readStream.schema("key string, ts long, event_id long, at timestamp").parquet(str(tmp_path / "in"))


def shuffled(spark, folder, rows, batches, spread):
    """A stream of calls that come up to ``spread`` seconds out of order, in files of one batch each, and one far later call."""
    rng = random.Random(7)
    rows = sorted(rows, key=lambda r: r[1] + rng.randrange(spread))
    size = -(-len(rows) // batches)
    schema = "key string, ts long, id long"
    for b in range(batches):
        spark.createDataFrame(rows[b * size : (b + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/b={b:03d}")
    spark.createDataFrame([("end", 10_000_000, -1)], schema).coalesce(1).write.parquet(f"{folder}/b={batches:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.fixture
def typed_state(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    admission.with_state_store(spark)
    yield spark
    spark.conf.set(name, before)


def test_sliding_window_of_shuffled_calls(typed_state, tmp_path):
    """Batch and stream agree whatever the order and the batches; quiet keys are forgotten."""
    spark, rng = typed_state, random.Random(3)
    rows = [(f"k{rng.randrange(5)}", 1000 + rng.randrange(200) + 1000 * rng.randrange(2), i) for i in range(500)]
    stream = shuffled(spark, tmp_path / "in", rows, 3, 60)
    got = run(admission.admitted_stream(stream, limit=3, seconds=20, late="2 minutes"), "window", spark)
    want = quota.admitted(spark.createDataFrame(rows, "key string, ts long, id long"), limit=3, seconds=20)
    assert {r.id: r.admitted for r in got.where("id >= 0").collect()} == {r.id: r.admitted for r in want.collect()}
    last = [p["stateOperators"][0] for p in spark.streams_run.recentProgress if p["stateOperators"]][-1]
    assert last["numRowsTotal"] < 20 and last["numRowsDroppedByWatermark"] == 0


def test_token_bucket_of_shuffled_calls(typed_state, tmp_path):
    spark, rng = typed_state, random.Random(4)
    rows = [(f"k{rng.randrange(3)}", 500 + rng.randrange(300), i) for i in range(200)]
    stream = shuffled(spark, tmp_path / "in", rows, 2, 40)
    got = run(admission.token_bucket_stream(stream, per_minute=6, burst=2, late="2 minutes"), "bucket", spark)
    want = {}
    for key in {r[0] for r in rows}:
        at, tokens = None, 2.0
        for _, t, i in sorted(r for r in rows if r[0] == key):
            tokens = 2.0 if at is None else min(2.0, tokens + (t - at) * 0.1)
            at, want[i] = t, tokens > 1 - 1e-9
            tokens -= want[i]
    assert {r.id: r.admitted for r in got.where("id >= 0").collect()} == want


def test_rollup(spark, sf, tmp_path):
    batch, stream = source(spark, sf, tmp_path)
    got = run(limits.rollup_stream(stream, "at"), "rollup", spark, "complete")
    assert got.agg(F.sum("n")).first()[0] == batch.count()


def test_cache_writer(spark, tmp_path):
    """Batches in any number, one missing, one run again, and the whole written anew."""
    path = str(tmp_path / "c")
    schema = "canonical_url string, markdown string, fetched_at long, headers map<string,string>"
    make = lambda *rows: spark.createDataFrame([(*r, {"k": r[1]}) for r in rows], schema)
    have = lambda: {r.canonical_url: r.markdown for r in limits.cached_pages(spark, path).collect()}
    assert limits.cached_pages(spark, path) is None
    write = limits.cache_writer(path, every=3)
    write(make(("u", "a", 1), ("v", "b", 1)), 0)
    write(make(("u", "c", 2)), 2)
    assert have() == {"u": "c", "v": "b"}
    write(make(("u", "c", 2)), 2)
    assert limits.versions(spark, path) == (-1, [0, 2])
    write(make(("w", "d", 3), ("w", "e", 4)), 3)
    assert limits.versions(spark, path) == (3, []) and have() == {"u": "c", "v": "b", "w": "e"}
    write(make(("w", "old", 1), ("v", "f", 9)), 7)
    assert limits.versions(spark, path) == (3, [7]) and have() == {"u": "c", "v": "f", "w": "e"}


def plain_serving(requests, outcomes, ttl, times, deadline):
    """The answers, second by second."""
    pages, waiting, out = {}, {}, {}
    last = max(r[2] for r in requests) + deadline + 1

    def failed(i, url, t):
        body, at = pages.get(url, (None, None))
        out[i] = ("cache_stale", body) if at is not None and t - at <= ttl * times else ("error", None)

    for t in range(min(r[2] for r in requests + outcomes), last + 1):
        for i, url, _, ok, body in sorted(o for o in outcomes if o[2] == t):
            if ok:
                pages[url] = (body, t)
            if i in waiting:
                waiting.pop(i)
                if ok:
                    out[i] = ("fetched", body)
                else:
                    failed(i, url, t)
        for i, url, _ in sorted(r for r in requests if r[2] == t):
            body, at = pages.get(url, (None, None))
            if at is not None and t - at <= ttl:
                out[i] = ("cache", body)
            else:
                waiting[i] = (url, t)
        for i, (url, asked) in sorted(waiting.items()):
            if asked + deadline <= t:
                waiting.pop(i)
                failed(i, url, t)
    return out


def test_pages_served_from_shuffled_streams(typed_state, tmp_path):
    """Fresh, stale, too old, late and missing outcomes: as second by second, in any order of arrival."""
    spark, rng = typed_state, random.Random(11)
    urls = [f"https://e.test/{k}" for k in range(4)]
    requests = [(i, rng.choice(urls), 1000 + rng.randrange(400)) for i in range(150)]
    outcomes = [(i, u, t + rng.randrange(0, 25), rng.random() < 0.4, f"page {i}") for i, u, t in requests if rng.random() < 0.8]
    end = [(-1, "end", 100_000)]
    for name, rows, schema, last in (("r", requests, "id long, canonical_url string, at long", end), ("o", outcomes, "request_id long, canonical_url string, at long, ok boolean, markdown string", [(*end[0], True, "")])):
        rows = sorted(rows, key=lambda r: r[2] + rng.randrange(40))
        for b in range(2):
            half = rows[b * len(rows) // 2 : (b + 1) * len(rows) // 2]
            spark.createDataFrame(half, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/b={b}")
        spark.createDataFrame(last, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/b=9")
    streams = [spark.readStream.schema(x).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}") for n, x in (("r", "id long, canonical_url string, at long"), ("o", "request_id long, canonical_url string, at long, ok boolean, markdown string"))]
    got = run(stale.served(*streams, ttl=30, stale=3, deadline=15, late="2 minutes"), "served", spark).where("id >= 0").collect()
    want = plain_serving(requests, outcomes, 30, 3, 15)
    assert {r.id: (r.action, r.markdown) for r in got} == want and len(got) == len(requests)
    assert {r.action for r in got} == {"cache", "fetched", "cache_stale", "error"}
