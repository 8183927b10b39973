"""Specs as rows against the specs as code, engine by engine."""

import pytest

from pagefuse.plans.replies import spec_template
from pagefuse.sources import json_replies, spec_rows

ODD = [
    ("npm", '{"objects":[{"package":{"name":"a","description":" d <b>x</b> ","version":1.0}},{"package":{"name":" "}},{"x":1}]}'),
    ("hackernews", '{"hits":[{"title":null,"story_title":"s","objectID":7,"points":3},{"story_title":"s","objectID":8},{"title":"t","objectID":true,"points":1.5}]}'),
    ("crossref", '{"message":{"items":[{"title":["first","second"],"DOI":"10.1/x","abstract":"<p>a  b</p>"},{"title":[],"DOI":"10.1/y","abstract":"<i> </i>"}]}}'),
    ("wiby", '{"a":1}'), ("wiby", "[]"), ("wiby", "no json"), ("wiby", None), ("hex", '[{"name":"n","meta":{"description":"x"}},3,null,"s"]'), ("crowdview", '{"results":{"a":{"url":"u"}}}'), ("none", "[]"), (None, "[]"),
]


def test_rows_equal_code(spark):
    rows = [(k, *r) for k, r in enumerate(ODD)] + [(100 + k, n, spec_template(s)) for k, (n, s) in enumerate(json_replies.SPECS.items())]
    d = spark.createDataFrame(rows, "query_id long, engine string, payload string").selectExpr("*", "1 AS fields", "2 AS results")
    specs = spec_rows.known(spark)
    key = lambda r: (r.query_id, r.engine, r.rank, r.title, r.url, r.snippet, r.published_date, r.thumbnail_url, tuple(sorted(r.metadata.items())))
    got = {key(r) for r in spec_rows.extract(d, specs).collect()}
    want = {key(r) for n in json_replies.SPECS for r in json_replies.extract(d.where(d.engine == n), json_replies.SPECS[n]).collect()}
    assert got == want and len(got) > 60
    bad = {(r.query_id, r.error) for r in spec_rows.failures(d, specs).collect()}
    assert {k for k, _ in bad} == {3, 5, 6, 8, 9, 10} and {e for k, e in bad if k in (9, 10)} == {"engine has no spec"}
    assert spec_rows.extract(d.limit(0), specs).count() == 0


def test_one_parse_and_one_stage(spark):
    d = spark.createDataFrame([(1, n, "[]") for n in json_replies.SPECS], "query_id long, engine string, payload string")
    plan = spec_rows.extract(d, spec_rows.known(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan and "Python" not in plan


def test_two_specs_of_one_engine(spark):
    specs = spec_rows.known(spark)
    with pytest.raises(ValueError):
        spec_rows.extract(spark.createDataFrame([(1, "npm", "[]")], "query_id long, engine string, payload string"), specs.union(specs))
