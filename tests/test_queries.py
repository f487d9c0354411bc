"""Every registered query beside its checking SQL on the smallest folder."""

import duckdb
import pytest

import __spark_entry__ as contract
from tierflow.plans.registered import ORACLE, QUERIES
from tools.check_queries import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note, _, _ = compare(con, spark, SF, name, QUERIES[name], ORACLE[name])
    assert ok, note


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))
