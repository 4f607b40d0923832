"""Every reference query against its oracle on the smallest tables."""

import pytest
from conftest import DATA, plain

from focalframe import plans


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    if name not in plans.ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3200
    assert set(e.oracle_sql()) <= set(e.queries())
