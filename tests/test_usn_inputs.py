"""The usn network's inputs that Spark builds from narrower rows."""

import datetime as dt

import pytest
from conftest import rows

from tierflow.plans import driver_tables, policy
from tierflow.plans.driver_tables import usn_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_inventory_comes_from_the_pairs(spark):
    """It took a pass over the shipments of its own; without a part there is one null usn for a warehouse."""
    day = dt.datetime(2000, 1, 3)
    lines = [(1, 1, "F"), (1, 1, "O"), (1, 1, "F"), (2, 1, None), (2, 2, "O"), (None, 1, "F"), (None, 1, "O"), (3, 3, "F"), (None, 9, "F")]
    t = {
        "lineitem": spark.createDataFrame([(1, i, p, s, 1, "N", k, day, 1.0, 1.0) for i, (p, s, k) in enumerate(lines)],
            "l_orderkey long, l_linenumber int, l_partkey int, l_suppkey int, l_tax int, l_returnflag string, l_linestatus string, l_shipdate timestamp, l_quantity double, l_extendedprice double"),
        "supplier": spark.createDataFrame([(1, 4), (2, None), (3, 4), (3, 5)], "s_suppkey int, s_nationkey int"),
    }
    for name in ("shipments", "dated_pairs"):
        text = driver_tables.spark_text(name)
        t[name] = spark.sql(text, **{r: t[r] for r in driver_tables.references(text)})
    got, want = (spark.sql(x, **{r: t[r] for r in driver_tables.references(x)}) for x in (driver_tables.spark_text("inventory_master"), driver_tables.SQL["inventory_master"]))
    assert got.dtypes == want.dtypes and rows(got) == rows(want) and want.count() == 7
    assert rows(usn_tables(spark, SF)["inventory_master"]) == rows(spark.sql(driver_tables.SQL["inventory_master"], shipments=usn_tables(spark, SF)["shipments"]))
    assert "dated-pairs" in usn_tables(spark, SF)["inventory_master"]._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [policy.FEW_ROWS, 0])
def test_lines_are_not_shuffled_for_a_table_of_few_suppliers(spark, monkeypatch, no_broadcast, few):
    monkeypatch.setattr(driver_tables.policy, "FEW_ROWS", few)
    text = usn_tables(spark, SF)["shipments"]._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning(l_suppkey" in text) == (few == 0)
