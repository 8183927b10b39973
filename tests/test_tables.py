"""SQL's table functions against the DataFrame forms."""

import pytest
from compare import rows

from pagefuse.functions import tables
from pagefuse.operators import fuse
from pagefuse.plans.queries import page_hits
from pagefuse.sources import json_replies


@pytest.mark.parametrize(("limit", "weights"), [(10, None), (3, {"kw": 2.5}), (None, {"len": 0.5, "fresh": 3.0})])
def test_fuse_hits(spark, sf, limit, weights):
    tables.register(spark)
    hits = page_hits(spark, sf)
    extra = spark.createDataFrame([(1, "kw", 5, 1, "no url", None, "s"), (1, "len", 6, 1, "no url", None, "longer"), (1, "len", 6, 2, None, None, None)], "query_id long, engine string, engine_ord int, rank int, title string, url string, snippet string")
    hits = hits.select(*extra.columns).unionByName(extra).selectExpr("*", "concat(engine, rank) AS mine")
    hits.createOrReplaceTempView("hits_view")
    fixed = f"map({', '.join(f'{k!r}, {v}D' for k, v in weights.items())})" if weights else "map()"
    args = f"TABLE(hits_view), {limit if limit is not None else 'CAST(NULL AS INT)'}, CAST({fixed} AS MAP<STRING, DOUBLE>)"
    got = spark.sql(f"SELECT * FROM fuse_hits({args})")
    want = fuse.fuse(hits, weights, limit)
    assert sorted(got.columns) == sorted(want.columns) and "mine" in got.columns
    assert rows(got.toPandas()) == rows(want.toPandas())
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM fuse_hits(TABLE(SELECT 1 AS query_id))").collect()


def test_json_hits(spark):
    tables.register(spark)
    payload = '{"d":{"items":[{"n":" a <b>x</b> ","id":1,"v":1.5},{"n":null,"m":"f","id":2},{"m":"f","id":3,"k":{"z":[7]}},{"n":"no url"},{"n":" ","id":"  "},3]}}'
    d = spark.createDataFrame([(1, "e", payload), (2, "e", "[]"), (3, "e", None), (4, "e", "{")], "query_id long, engine string, payload string")
    d.createOrReplaceTempView("replies_view")
    spec = '{"results": "d.items", "url": {"path": "id", "prefix": "https://e.test/"}, "title": {"path": "n", "fallback": "m", "strip_html": true}, "version": "v", "deep": "k.z.0"}'
    got = spark.sql(f"SELECT * FROM json_hits(TABLE(replies_view), '{spec}')")
    assert got.columns == ["query_id", "engine", "rank", "title", "url", "version", "deep"]
    f = json_replies.Field
    want = json_replies.extract(d, json_replies.Spec("d.items", f("n", "m", strip_html=True), f("id", prefix="https://e.test/"), metadata={"version": f("v"), "deep": f("k.z.0")}))
    want = want.selectExpr("query_id", "engine", "rank", "title", "url", "metadata['version'] AS version", "metadata['deep'] AS deep")
    assert rows(got.toPandas()) == rows(want.toPandas()) and got.count() == 3
    with pytest.raises(Exception, match="no url"):
        spark.sql("SELECT * FROM json_hits(TABLE(replies_view), '{}')").collect()
