"""Admission by min-plus matrices against one call after the other."""

import numpy as np
import pytest

from pagefuse.operators import admission, quota


def plain(calls, limit, seconds):
    """Whether each call is admitted, in order of (key, time, id)."""
    out, open_ = {}, {}
    for key, ts, i in sorted((c for c in calls if c[1] is not None), key=lambda c: (str(c[0]), c[1], c[2])):
        window = [x for x in open_.get(key, []) if x >= ts - seconds]
        out[i] = len(window) < limit
        open_[key] = window + [ts] * out[i]
    return out | {c[2]: False for c in calls if c[1] is None}


@pytest.mark.parametrize(("limit", "seconds"), [(1, 0), (1, 1), (3, 2), (5, 10), (20, 60)])
def test_recurrence_and_matrices(limit, seconds):
    """Any cut into stretches gives the same counts, whether a stretch starts from values or goes through its matrix."""
    rng, w = np.random.default_rng(limit), seconds + 1
    for _ in range(60):
        length = w * int(rng.integers(1, 6))
        total = length * 4
        n = np.where(rng.random(total) < rng.choice([0.02, 0.3, 0.9]), rng.integers(1, limit + 3, total), 0)
        want, c = [], 0
        for t in range(total):
            own = min(n[t], limit - sum(want[max(0, t - seconds) :]))
            want.append(int(own))
        c = np.cumsum(want)
        start = np.zeros(w, dtype=np.int64)
        for k in range(4):
            own = n[k * length : (k + 1) * length]
            at = np.flatnonzero(own)
            up, last = admission.admitted_up_to(at, own[at], start[:, None], limit, length)
            assert (up[:, 0] == c[k * length + at]).all()
            _, matrix = admission.admitted_up_to(at, own[at], admission.unit(w), limit, length)
            assert (admission.through(matrix, start) == last[:, 0]).all()
            start = last[:, 0]


@pytest.mark.parametrize(("limit", "seconds", "stretch"), [(2, 5, 6), (5, 60, 61), (3, 10, 40)])
def test_calls_of_many_keys(spark, limit, seconds, stretch):
    rng = np.random.default_rng(seconds)
    rows = []
    for k, key in enumerate(["hot", "warm", "sparse", "burst", None, ""]):
        n = [1500, 300, 20, 200, 50, 30][k]
        ts = rng.integers(-50, [400, 900, 100_000, 8, 300, 60][k], n)
        rows += [(key, int(t), len(rows) + j) for j, t in enumerate(ts)]
    rows += [("hot", None, len(rows)), (None, None, len(rows) + 1)]
    d = spark.createDataFrame(rows, "key string, ts long, id long").repartition(3)
    got = admission.admitted(d, "key", "ts", "id", limit, seconds, stretch).collect()
    assert {r.id: r.admitted for r in got} == plain(rows, limit, seconds) and len(got) == len(rows)
    assert admission.admitted(d.limit(0), "key", "ts", "id", limit, seconds).count() == 0


def test_one_hot_key_is_spread(spark):
    """Every call belongs to one key, a third of them to one second: no task of a ranking or of a stretch has most of the rows."""
    d = spark.range(6000).selectExpr("'k' AS key", "CASE WHEN id % 3 = 0 THEN 77 ELSE id END AS ts", "id")
    got = quota.admitted(d, limit=4, seconds=9)
    want = plain([("k", 77 if i % 3 == 0 else i, i) for i in range(6000)], 4, 9)
    assert {r.id: r.admitted for r in got.collect()} == want
    let = admission.per_second(d.selectExpr("CAST(key AS BINARY) AS key", "ts", "1L AS n").groupBy("key", "ts").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"), 4, 9, stretch=100)
    assert let.groupBy("key").sum("admitted").first()[1] == sum(want.values())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "pandas" not in plan.lower()
