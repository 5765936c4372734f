"""Every query against its SQL on the smallest tables, and the entry point's promises."""

import pytest

import __spark_entry__ as driver
from tests.conftest import SMALL
from tests.oracle import compare, connection
from vacantia.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE_SQL:
        same, what = compare(df, con, ORACLE_SQL[name])
        assert same, what
    else:
        assert df.count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
