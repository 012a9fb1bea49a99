"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from check import rows


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(set(spark_entry.queries()) & set(spark_entry.oracle_sql())))
def test_query(spark, sf, db, name):
    df = spark_entry.queries()[name](spark, sf)
    expected = db.execute(spark_entry.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, expected.fetchall())


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_scans_read_only_what_they_need(spark, sf):
    plan = spark_entry.queries()["branch_two"](spark, sf)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("FileScan") == 1
    assert "l_partkey" not in text and "l_tax" not in text
    plan = spark_entry.queries()["chain_two"](spark, sf)._jdf.queryExecution().executedPlan()
    assert "EqualTo(o_orderstatus,F)" in plan.toString()
