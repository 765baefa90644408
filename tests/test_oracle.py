"""Every query against its SQL oracle on the small tables: columns, types, rows, values."""

import duckdb
import pytest

import __spark_entry__ as driver
from checks import catalog
from checks.fixtures import BASE_TABLES
from tests.tieout import as_sorted_rows

DATA = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, key):
    got = QUERIES[key](spark, DATA).toArrow()
    want = duck.sql(ORACLES[key]).to_arrow_table()
    assert as_sorted_rows(got) == as_sorted_rows(want)
    types = {f.name: str(f.type) for f in got.schema}
    assert types == {f.name: str(f.type).replace("large_", "") for f in want.schema}


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0
