"""Every registered query of the engine against its DuckDB SQL, or at least run."""

import pytest
from compare import oracle, rows

from pagefuse.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = oracle(sf, ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
