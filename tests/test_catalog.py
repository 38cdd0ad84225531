"""Every catalogue query with an SQL statement gives exactly its rows at the smallest scale."""

import pytest

from ticklattice.plans.catalog import ORACLES, QUERIES

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, con, name):
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
