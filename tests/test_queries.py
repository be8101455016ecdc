"""Every registered query with a check equals its SQL on DuckDB; entry points have the right shape."""

import pytest

import __spark_entry__ as entry_points
from grainfold.plans import ORACLES, QUERIES
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 5
    assert abs(sum(r["share_pct"] for r in rows) - 100) < 0.01


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, con, name):
    assert difference(QUERIES[name](spark, folder), con.sql(ORACLES[name])) is None
