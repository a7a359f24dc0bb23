"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as driver
from checks.compare import compare, duckdb_connection
from checks.oracle import ORACLE
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duckdb_connection(sf_dir)


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_oracle(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) == ""


@pytest.mark.parametrize("name", ["feature_importance", "train_linear"])
def test_query_without_oracle_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_registry(spark):
    assert set(ORACLE) <= set(QUERIES)
    assert QUERIES.keys() <= driver.queries().keys() and ORACLE.items() <= driver.oracle_sql().items()
    assert driver.oracle_sql().keys() <= driver.queries().keys()
    assert driver.entry(spark).count() == 3
