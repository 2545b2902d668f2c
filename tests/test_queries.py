"""Every registered query on the smallest tables against its SQL."""

import pytest

import __spark_entry__ as entry_points
from checking import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
