"""Rows that both status rules share, beside the rows that each rule joins for itself."""

import datetime as dt
import re

import pytest
from conftest import DAY, rows
from test_universe import EARLY, PARAMS, catalogue_row, material_tables

from tierflow.operators import classify, dims, impact, stock, universe
from tierflow.plans import policy, registered, runs
from tierflow.plans.params import material_network
from tierflow.sources.registry import stage

SF = "/root/testdata/sf0.001"
LATE = dt.date(1999, 6, 1)


def odd_tables(spark):
    """Keys that repeat or are null in every table that the rows are joined to."""
    t = material_tables(spark)
    more = {
        "catalogue": [catalogue_row(maktx="other"), catalogue_row(matnr=None), catalogue_row(matnr="12", maktx=None)],
        "plant": [("P1", "P1", "N1"), (None, None, "N1")],
        "item_master": [("12", None, "M", "u", "Foil", None, 1.0), ("12", "EA", "M", "u", "x", "1", 3.0), (None, "EA", None, None, None, None, None)],
        "supersession": [("12", None), ("12", "98"), ("14", "1"), (None, "7")],
        "extract": [("12", "P1", "CS", "B", 2.0), ("12", "P1", "CS", None, None), ("13", "P1", "CS", None, 0.0),
                    ("13", "P1", "CS", None, -0.0), ("14", None, "CS", "A", 1.0), ("16", "P1", "CS", "A", float("nan"))],
        "atlas": [("P1", "12", "v1"), ("P1", None, "v1"), ("P1", "13", None), ("P1", "013", "v3")],
        "vendor_receipts": [("0012", "P1", "v1", EARLY), ("0012", "P1", "v1", LATE), ("0012", "P1", "v1", None),
                            ("12", "P1", "v1", LATE), ("013", "P1", "v3", None), ("13", "P1", None, EARLY)],
        "usn_receipts": [("u13", "W1", LATE), ("u13", "W1", EARLY), ("u13", "W1", None), ("u12", "W1", LATE), (None, "W1", EARLY)],
        "item_xref": [("u12", "12"), ("u12", "12"), (None, "13")],
        "forecast": [("P1", "12", DAY, 1.0), ("P1", "14", DAY, None), (None, "13", DAY, 2.0)],
        "soq": [("P1", "12", "FY2000", "FW01", 4.0), ("P1", "13", "FY2000", "FW02", None), (None, "13", "FY2000", "FW02", 1.0)],
    }
    extra = {n: t[n].unionByName(spark.createDataFrame(r, t[n].schema)) for n, r in more.items()}
    return {n: extra.get(n, t[n]) for n in t}


@pytest.mark.parametrize("mode", ["no_receipt", "coalesced", "recent"])
def test_dated_rows_give_the_rows_of_each_rule(spark, mode):
    t, net = odd_tables(spark), material_network(status_mode=mode)
    want = runs.active_universe(t, PARAMS, net, "material")
    dated = runs.dated_universe(t, PARAMS, material_network(status_mode="no_receipt"))
    got = universe.with_receipts(dated, PARAMS, net).select(*want.columns)
    # as text, for NaN is not equal to itself
    assert [str(r) for r in rows(got)] == [str(r) for r in rows(want)] and want.count() > 4


def test_dated_rows_are_distinct_without_grouping_wide_rows(spark):
    t, net = odd_tables(spark), material_network()
    dated = runs.dated_universe(t, PARAMS, net)
    assert dated.count() == dated.distinct().count()
    top = dated._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "Aggregate" not in top


def test_runs_under_two_rules_join_once(spark, monkeypatch):
    """Each run joined its own universe before."""
    built = []
    whole = universe.universe_material
    monkeypatch.setattr(runs, "universe_material", lambda *a, **k: built.append(1) or whole(*a, **k))
    runs.rule_change(material_tables(spark), PARAMS, material_network())
    assert len(built) == 1
    for which in ("before", "after"):
        text = registered.run_of(spark, SF, which)._jdf.queryExecution().executedPlan().toString()
        assert "dated-universe" in text


def test_sums_by_material_are_read_not_made_twice(spark):
    t = material_tables(spark)
    price = dims.unit_price_avg(t["order_lines"], t["order_headers"], t["catalogue"], t["plant_ext"], "N1", DAY)
    text = price._jdf.queryExecution().executedPlan().toString()
    assert "priced-materials" in text and rows(price) == [("12", "P1", 8.0)]


def test_parts_of_the_joins_grow_with_the_catalogue(spark, monkeypatch):
    """Spark dealt the rows over as many parts as the session names, however many they are."""
    t, net = odd_tables(spark), material_network()
    want = rows(runs.dated_universe(t, PARAMS, net))
    parts, old = t["catalogue"].count(), spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(universe.policy, "FEW_ROWS", 0)
    monkeypatch.setattr(universe.policy, "ROWS_PER_PART", 1)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        dated = runs.dated_universe(t, PARAMS, net)
        text = dated._jdf.queryExecution().executedPlan().toString()
        assert parts > 2 and len(re.findall(rf", {parts}\), REPARTITION_BY_NUM", text)) >= 4
        assert [str(r) for r in rows(dated)] == [str(r) for r in want]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_date_lists_are_made_in_one_pass(spark):
    """Receipts were made distinct before their lists were, which are sets themselves."""
    dated = runs.dated_universe(odd_tables(spark), PARAMS, material_network())
    text = dated._jdf.queryExecution().optimizedPlan().toString()
    lists = [k for k in re.findall(r"(?m)^.*collect_set.*$\n(.*)$", text)]
    assert len(lists) == 2 and not any("Aggregate" in below for below in lists)


def test_stock_of_carried_lists_moves_no_wide_row(spark):
    """safety_stock shuffled the wide rows by item and again by plant and item."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("safety_stock", "coverage_weeks"):
            text = registered.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
            assert "null_spread" not in text and "inline" in text.lower()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not {"__orders", "__item_flags"} & set(registered.QUERIES["coverage_weeks"](spark, SF).columns)


def test_the_merge_moves_only_what_the_report_reads(spark):
    """All columns of the new run went through the shuffle of the merge."""
    cohort = registered.cohort_of(spark, SF)
    assert not {"sku_description_new", "material_id_new", "retail_price_old", "cube_new"} & set(cohort.columns)
    before, after = (registered.analysis_of(spark, SF, w) for w in ("before", "after"))
    whole = impact.cohort_of(before, after).select(*cohort.columns)
    assert rows(cohort) == rows(whole) and whole.count() > 0


def test_carried_lists_give_the_rows_of_the_lookups(spark):
    t, net = odd_tables(spark), material_network()
    carried = universe.with_receipts(stage(runs.dated_universe(t, PARAMS, net), "dated"), PARAMS, net)
    orders = dims.soq_first_weeks(t["soq"], PARAMS.fiscal_year, PARAMS.projection_weeks)

    def stocked(base):
        covered = stock.sscov(classify.classify(base, PARAMS), t["item_master"], net.high_cube_categories)
        return stock.safety_stock(covered, t["plant"], orders)

    got, want = stocked(carried), stocked(carried.drop(*policy.CARRIED_LISTS))
    assert sorted(got.columns) == sorted(want.columns)
    assert [str(r) for r in rows(got.select(*want.columns))] == [str(r) for r in rows(want)] and want.count() > 4
