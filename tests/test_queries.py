"""Every registered query against its SQL on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from pathlight.plans.catalog import ORACLES, QUERIES
from tools.check import TABLES, canonical

FOLDER = os.environ.get("TESTDATA", "/root/testdata") + "/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = canonical([tuple(row) for row in frame.collect()], frame.columns)
    sql = ORACLES.get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    columns = [column[0] for column in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert got == canonical(result.fetchall(), columns)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())
