"""Steps that were rewritten so that wide rows are shuffled once, beside plain versions."""

import datetime as dt

import pytest
from conftest import rows

from tierflow.operators import dims, stock, universe
from tierflow.plans import driver_tables, registered
from tierflow.plans.driver_tables import MATERIAL, PARAMS, material_tables
from tierflow.plans.runs import active_universe

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_universe_rows_are_placed_once(spark, no_broadcast):
    text = plan(active_universe(material_tables(spark, SF), PARAMS, MATERIAL, "material"))
    # the forecast join, which comes last, takes the rows as the join below it leaves them
    assert "Exchange" not in text.split("SortMergeJoin")[1]
    assert text.count("REPARTITION_BY_COL") == 2  # the catalogue and the cross receipts


def test_forecast_sums_lie_as_the_universe(spark):
    """With its keys the other way round adaptive execution moved the universe's rows to the sums."""
    t = material_tables(spark, SF)
    text = plan(dims.forecast_window(t["forecast"], t["plant"], "N1", driver_tables.AS_OF))
    assert "hashpartitioning(item#" in text and "hashpartitioning(location#" not in text


def test_analysis_shuffles_no_rows_for_the_stock_lookups(spark, no_broadcast):
    text = plan(registered.run_of(spark, SF, "after"))
    assert "null_spread" not in text and "hashpartitioning(soq_plant" not in text


@pytest.mark.parametrize("name", ["pairs", "receipts", "catalogue", "extract", "soq", "state_report"])
def test_narrow_texts_give_the_rows_of_the_sql(spark, name):
    t = material_tables(spark, SF)
    text = driver_tables.SQL[name]
    plain = spark.sql(text, **{r: t[r] for r in driver_tables.references(text)})
    assert t[name].dtypes == plain.dtypes and rows(t[name]) == rows(plain)


def test_projections_of_shipments_are_not_stored(spark):
    t = material_tables(spark, SF)
    for name in ("shipments", "order_lines", "instock_weekly", "atlas", "vendor_receipts"):
        assert "lineitem" in plan(t[name]) or "dated-pairs" in plan(t[name])


def test_carried_lists_give_the_rows_of_the_lookups(spark):
    """Items and plants that repeat, that no lookup knows, or that are null."""
    items = spark.createDataFrame(
        [("1", "1", "B", 1.0), ("1", None, "x", 2.0), ("2", "2", "B", 1.0), ("2", "2", "B", 3.0), (None, "1", "B", 1.0)],
        "dmdunit string, udc_import_type string, udc_product_cat_descr string, udc_pir_cost double",
    )
    plant = spark.createDataFrame([("p", "L1"), ("p", "L2"), ("q", "L1"), ("q", "L1"), ("r", None)], "plant_id string, network_plant_id string")
    orders = spark.createDataFrame([("L1", "1", 5.0), ("L1", "1", 7.0), ("L2", "2", None), ("L3", "1", 1.0)], "plant string, item string, total_soq double")
    places = [(i, d) for i in ("1", "2", "3") for d in ("p", "q", "r", "s", None)]
    df = spark.createDataFrame(
        [(i, d, "A", "C", 2.0, 3.0) for i, d in places],
        "item string, dc string, system_velocity string, new_proposed_velocity string, weekly_average_forecasted_qty double, cogs double",
    )
    carried = df.join(stock.flags_by_item(items, ("B",)), "item", "left").join(stock.orders_by_place(plant, orders), ["item", "dc"], "left")

    def both(x):
        return stock.safety_stock(stock.sscov(x, items, ("B",)), plant, orders)

    want = both(df)
    assert rows(both(carried).select(*want.columns)) == rows(want) and want.count() > df.count()


def test_own_receipts_match_material_and_vendor(spark):
    day = dt.date(2000, 1, 1)
    listed = spark.createDataFrame(
        [("1", "p", "01", "v"), ("1", "p", "1", "v"), ("1", "p", "01", None), ("2", "p", "2", "w"), ("2", "p", "2", "w")],
        "item string, dc string, material string, vendor string",
    )
    receipts = spark.createDataFrame(
        [("01", "p", "v", day), ("01", "p", "v", day), ("01", "p", None, day), ("2", "p", "w", day), ("2", "p", "w", None), ("2", "q", "w", day)],
        "material_nbr string, plant string, vendor_nbr string, vendor_sku_dc_first_receive_date date",
    )
    got = rows(universe._own_receipts(listed, receipts))
    assert got == sorted([("1", "p", day), ("1", "p", None), ("2", "p", day), ("2", "p", None)], key=lambda r: [(v is None, str(v)) for v in r])
