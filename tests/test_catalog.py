"""Every query with SQL against DuckDB; the others by their shape."""

import pytest
from tessera.plans.catalog import QUERIES, SQL
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(same, name):
    assert same(QUERIES[name], SQL[name], DATA / "sf0.001") >= 0


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA / "sf0.001")).count() > 0
