"""Ranking, tiers, coverage and outputs against brute force and golden rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import DAY, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tierflow.operators import classify, output, stock
from tierflow.plans.params import TierParams

PARAMS = TierParams(as_of=DAY, fiscal_year="FY2000")


def brute_force(pdf):
    """Percent rank by counting, nulls on top, ties share."""
    value = pdf["w"].fillna(np.inf)
    out = []
    for _, g in pdf.assign(v=value, group=pdf["dc"].astype(str) + "|" + pdf["mcat"].astype(str)).groupby("group"):
        n = len(g)
        above = g["v"].apply(lambda x: (g["v"] > x).sum())
        share = (above / (n - 1)) if n > 1 else above * 0.0
        # half up, as the engine rounds
        out.append(np.floor(share * 1000 + 0.5 + 1e-9) / 1000)
    return pd.concat(out).reindex(pdf.index)


def check_percentiles(spark, pdf):
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id int, dc string, mcat string, w double")
    got = classify.tier_percentile(df, weight="w").toPandas().set_index("id").sort_index()
    want = brute_force(pdf.set_index("id").sort_index())
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["calculated_velocity_percentile"].astype(float), want, atol=1e-9)


def test_percentile_large_group_with_ties_and_null_group(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame(
        {
            "id": range(n),
            # one group holds two thirds of the rows, and a third of it is one weight
            "dc": np.where(rng.random(n) < 0.66, "1", rng.integers(2, 9, n).astype(str)),
            "mcat": np.where(rng.random(n) < 0.8, "a", None),
            "w": np.where(rng.random(n) < 0.33, 0.0, np.round(rng.lognormal(3, 2, n), 2)),
        }
    )
    pdf.loc[rng.random(n) < 0.01, "w"] = np.nan
    check_percentiles(spark, pdf)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["1", "2"]),
            st.sampled_from(["a", None]),
            st.one_of(st.none(), st.sampled_from([0.0, 1.0, 1e-9, 1e12]), st.floats(-1e6, 1e6)),
        ),
        min_size=1,
        max_size=40,
    )
)
def test_percentile_property(spark, data):
    pdf = pd.DataFrame([(i, *r) for i, r in enumerate(data)], columns=["id", "dc", "mcat", "w"])
    pdf["w"] = pdf["w"].astype(float)
    check_percentiles(spark, pdf)


def test_tier_cutoffs_after_rounding(spark):
    df = spark.createDataFrame(
        [(0.1, 1.0), (0.101, 1.0), (0.3, 1.0), (0.6, 1.0), (0.601, 1.0), (1.0, 1.0), (None, 1.0), (0.1, None)],
        "calculated_velocity_percentile double, cogs double",
    )
    got = [r[0] for r in df.select(classify.tier(PARAMS)).collect()]
    assert got == ["A", "B", "B", "C", "D", "D", None, "Missing Data"]


BASE = (
    "is_forecasted string, sku_status string, superseded_sku string, dc string, mcat string, item string, "
    "material_id string, usn string, cogs double, total_forecasted_qty double"
)


def test_every_row_gets_one_tier(spark):
    base = [
        (f, s, x, "1", "m", f"{f}{s}{x}{k}", None, "u", 2.0 * k, 13.0 * k)
        for f in ("Forecasted", "Not Forecasted")
        for s in ("New", "Not New")
        for x in ("superseded", "not superseded")
        for k in range(5)
    ]
    df = spark.createDataFrame(base, BASE)
    got = classify.classify(df, PARAMS)
    assert got.count() == len(base)
    tiers = {(r[0], r[1], r[2]): set() for r in base}
    for r in got.collect():
        tiers[r["is_forecasted"], r["sku_status"], r["superseded_sku"]].add(r["new_proposed_velocity"])
        ranked = r["is_forecasted"] == "Forecasted" and (r["sku_status"] == "Not New" or r["superseded_sku"] == "superseded")
        assert (r["calculated_velocity_percentile"] is not None) == ranked
        assert r["sku"] == "u"
    assert tiers["Forecasted", "New", "not superseded"] == {"C"}
    assert tiers["Not Forecasted", "New", "superseded"] == {"C"}
    assert tiers["Not Forecasted", "Not New", "superseded"] == {"E"}
    assert tiers["Forecasted", "Not New", "superseded"] <= set("ABCD")
    parts = classify.ranked_tiers(df, PARAMS).unionByName(classify.forced_c(df, PARAMS)).unionByName(
        classify.unforecast_tier(df, PARAMS)
    )
    assert rows(parts) == rows(got)


def test_attach_forecast(spark):
    columns = {c: "string" for c in classify.BASE_COLUMNS if c not in ("is_forecasted", "total_forecasted_qty")}
    columns |= {"is_active": "boolean", "is_filtered_out": "boolean", "receipt_date": "date"}
    columns |= {c: "double" for c in ("retail_price", "cogs", "instock_numerator", "instock_denominator", "instock_rate")}

    def row(**kw):
        return tuple(kw.get(c) for c in columns)

    good = {"dc": "1", "location": "L1", "item": "i", "is_active": True, "is_filtered_out": False}
    universe = spark.createDataFrame(
        [
            row(**good), row(**good), row(**good | {"item": "j"}), row(**good | {"is_active": False}),
            row(**good | {"is_filtered_out": True}), row(**good | {"location": None, "dc": "2"}),
            row(**good | {"item": None}),
        ],
        ", ".join(f"{c} {t}" for c, t in columns.items()),
    )
    forecast = spark.createDataFrame(
        [("L1", "i", 5.0), ("L2", "i", None)], "location string, item string, total_forecasted_qty double"
    )
    plant = spark.createDataFrame([("1", "LX"), ("2", "L2")], "plant_id string, network_plant_id string")
    got = rows(
        classify.attach_forecast(universe, forecast, plant).select(
            "location", "item", "is_forecasted", "total_forecasted_qty"
        )
    )
    assert got == [
        ("L1", "i", "Forecasted", 5.0), ("L1", "j", "Not Forecasted", 0.0),
        ("L1", None, "Not Forecasted", 0.0), ("L2", "i", "Forecasted", 0.0),
    ]


def test_coverage_and_stock(spark):
    df = spark.createDataFrame(
        [("1", "a", "A", "E", 1.0, 2.5), ("1", "b", None, "B", 2.0, 3.0), ("2", "x", "E", "A", 1.0, 1.0), ("2", "h", "A", "E", 1.0, 1.0)],
        "dc string, item string, system_velocity string, new_proposed_velocity string, "
        "weekly_average_forecasted_qty double, cogs double",
    )
    master = spark.createDataFrame(
        [("a", 1.0, "Lamps", "1"), ("b", 1.0, "Toilets", "1"), ("h", 1.0, "Foil", None)],
        "dmdunit string, udc_pir_cost double, udc_product_cat_descr string, udc_import_type string",
    )
    covered = stock.sscov(df, master)
    got = rows(covered.select("item", "import_flag", "cube", "current_sscov", "proposed_sscov"))
    assert got == [
        ("a", "Import", "Low", 6, 3), ("b", "Import", "High", 0, 4),
        ("h", "Domestic", "High", 3, 0), ("x", None, "Low", 0, 0),
    ]
    plant = spark.createDataFrame([("1", "L1"), ("2", None)], "plant_id string, network_plant_id string")
    orders = spark.createDataFrame([("L1", "a", 9.0)], "plant string, item string, total_soq double")
    got = rows(
        stock.safety_stock(covered, plant, orders).select(
            "item", "current_safety_stock", "proposed_safety_stock", "safety_stock_change",
            "safety_stock_change_dollars", "current_total_soq_13_weeks", "velocity_change_class",
        )
    )
    assert got == [
        ("a", 6.0, 3.0, -3.0, -7.5, 9.0, "Demotion"), ("b", 0.0, 8.0, 8.0, 24.0, 0.0, "Unclassified"),
        ("h", 3.0, 0.0, -3.0, -3.0, 0.0, "Demotion"), ("x", 0.0, 0.0, 0.0, 0.0, 0.0, "Promotion"),
    ]


def test_repeated_plants_repeat_stock_rows(spark):
    df = spark.createDataFrame(
        [("1", "a", 1.0, 1.0, 1, 2, "A", "B")],
        "dc string, item string, weekly_average_forecasted_qty double, cogs double, current_sscov int, "
        "proposed_sscov int, system_velocity string, new_proposed_velocity string",
    )
    plant = spark.createDataFrame([("1", "L1"), ("1", "L2")], "plant_id string, network_plant_id string")
    orders = spark.createDataFrame([("L1", "a", 9.0)], "plant string, item string, total_soq double")
    got = stock.safety_stock(df, plant, orders).select("current_total_soq_13_weeks")
    assert rows(got) == [(0.0,), (9.0,)]


def test_service_level_and_reason(spark):
    df = spark.createDataFrame([("A",), ("E",), ("Missing Data",), (None,)], "t string")
    assert [r[0] for r in df.select(output.service_level("t")).collect()] == [99.2, 80.0, 99999.0, 99999.0]
    df = spark.createDataFrame(
        [("Forecasted", "New", "superseded"), ("Forecasted", "Not New", "not superseded"),
         ("Forecasted", "New", "not superseded"), ("Not Forecasted", "New", "superseded"),
         ("Not Forecasted", "Not New", "x"), (None, "New", "superseded")],
        "is_forecasted string, sku_status string, superseded_sku string",
    )
    got = [r[0].split(":")[0] for r in df.select(output.velocity_reason()).collect()]
    assert got == [
        "Velocity Tier A-D Driver", "Velocity Tier A-D Driver", "Velocity Tier C Driver",
        "Velocity Tier C Driver", "Velocity Tier E Driver", "Other or Unclassified",
    ]


@pytest.mark.parametrize("extra", [(), ("usn", "dc")])
def test_changes_drop_null_system_tier(spark, extra):
    names = ["jda_item", "jda_loc", "new_proposed_velocity", "service_level", "system_velocity", "velocity_reason", *extra]
    data = [("i", "l", "A", 1.0, "B", "r"), ("j", "l", "A", 1.0, None, "r"), ("k", "l", "A", 1.0, "A", "r"), ("m", "l", "Missing Data", 1.0, "A", "r")]
    df = spark.createDataFrame([(*r, *["z" for _ in extra]) for r in data], names)
    got = output.changes(df, dt.date(2000, 1, 4))
    assert [r["jda_item"] for r in got.orderBy("jda_item").collect()] == ["i", "m"]
    assert set(extra) <= set(got.columns)
    upload = output.upload_rows(got)
    assert [r["jda_item"] for r in upload.collect()] == ["i"]
    assert "table_created_date" not in upload.columns
