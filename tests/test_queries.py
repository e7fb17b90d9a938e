"""Every registered query with SQL against DuckDB on the smallest tables; stable schemas for the rest."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from lynxmark.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = [n.removesuffix(".parquet") for n in sorted(os.listdir(DATA))] if os.path.isdir(DATA) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    text = frame[names].astype(str).replace({"nan": "None", "NaT": "None", "<NA>": "None"})
    return names, sorted(map(tuple, text.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_entry(spark):
    got = driver.entry(spark)
    assert got.columns == ["l_suppkey", "n", "chi2", "mad"]
    assert got.count() > 0


def test_all_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
