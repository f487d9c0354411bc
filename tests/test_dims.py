"""Golden rows for expressions and dimension preparation."""

import datetime as dt

import pytest
from conftest import DAY, rows
from pyspark.sql import functions as F

from tierflow.functions import div0, div0null, exact_sums, next_weekday, previous_weekday, zero_trim
from tierflow.operators import dims


def day(n):
    return DAY + dt.timedelta(days=n)


def test_divisions(spark):
    df = spark.createDataFrame(
        [(1, 6.0, 3.0), (2, 6.0, 0.0), (3, 6.0, None), (4, None, 0.0), (5, None, 2.0)],
        "id int, a double, b double",
    )
    got = rows(df.select("id", div0("a", "b"), div0null("a", "b")))
    assert got == [(1, 2.0, 2.0), (2, 0.0, 0.0), (3, None, 0.0), (4, 0.0, 0.0), (5, None, None)]


def test_weekdays_are_strict(spark):
    df = spark.createDataFrame([(day(0),), (day(1),), (day(6),)], "d date")
    got = rows(
        df.select("d", previous_weekday(F.col("d"), "MON"), next_weekday(F.col("d"), "SUN"))
    )
    # Monday, Tuesday, Sunday
    assert got == [
        (day(0), day(-7), day(6)),
        (day(1), day(0), day(6)),
        (day(6), day(0), day(13)),
    ]


def test_zero_trim_and_exact_sums(spark):
    df = spark.createDataFrame([("00120", 0.1), ("000", 0.2), ("12", None)], "id string, q double")
    assert rows(df.select(zero_trim("id"))) == [("",), ("12",), ("120",)]
    whole = lambda frame: exact_sums(frame, [F.lit(0).alias("all")], {"q": "q"}).first().q
    assert whole(df) == 0.3
    small = spark.createDataFrame([(4e-7,)] * 4, "q double")
    assert whole(small) == 1.6e-6
    large = spark.createDataFrame([(6e12,), (1e13,)], "q double")
    assert whole(large) == 1.6e13


def test_first_weeks_put_a_null_week_last(spark):
    data = [("p", "i", "FY", w, 1.0) for w in (None, "W01", "W02")]
    soq = spark.createDataFrame(data, "plant string, item string, orderplace_fy string, orderplace_fw string, soq double")
    assert dims.soq_first_weeks(soq, "FY", 2).first()["total_soq"] == 2.0


def test_calendar_info(spark):
    cal = spark.createDataFrame([(day(0), "W1"), (day(1), "W1")], "date_date date, fiscal_week_id string")
    assert rows(dims.calendar_info(cal, DAY)) == [("W1", day(-7), day(6))]
    assert rows(dims.calendar_info(cal, day(9))) == []


def test_vendor_team_keeps_first_analyst_of_each_raw_vendor(spark):
    rel = spark.createDataFrame(
        [("0123", "Zed", "M1"), ("0123", "Amy", "M2"), ("123", "Bob", "M3"), ("7", None, "M4"),
         ("7", "Yan", "M5")],
        "vendor string, inventory_analyst string, manager string",
    )
    assert rows(dims.vendor_team(rel)) == [
        ("123", "Amy", "M2"), ("123", "Bob", "M3"), ("7", "Yan", "M5"),
    ]


def test_unit_price_avg_filters(spark):
    lines = spark.createDataFrame(
        [
            ("o1", "0012", "Y", "ZT", None, None, "20000101", 10.0),
            ("o1", "12", "Y", "ZT", "ZF", "XX", "19990101", 20.0),
            ("o1", "0012", "N", "ZT", None, None, "20000101", 999.0),
            ("o1", "0012", "Y", "ZTAS", None, None, "20000101", 999.0),
            ("o1", "0012", "Y", None, None, None, "20000101", 999.0),
            ("o1", "0012", "Y", "ZT", "Q", None, "20000101", 999.0),
            ("o1", "0012", "Y", "ZT", None, "GA07", "20000101", 999.0),
            ("o1", "0012", "Y", "ZT", None, None, "nodate", 999.0),
            ("o1", "0012", "Y", "ZT", None, None, "19970101", 999.0),
            ("o2", "0012", "Y", "ZT", None, None, "20000101", 999.0),
            ("o3", "0012", "Y", "ZT", None, None, "20000101", 999.0),
            ("none", "0012", "Y", "ZT", None, None, "20000101", 999.0),
        ],
        "vbeln string, matnr string, zdel_ready string, pstyv string, abgru string, "
        "vstel string, zim_date string, netpr double",
    )
    headers = spark.createDataFrame(
        [("o1", "P1", "ZOR"), ("o2", "P1", None), ("o3", "P2", "ZOR")],
        "vbeln string, zzdef_werks string, auart string",
    )
    catalogue = spark.createDataFrame(
        [("P1", "0012", "X"), ("P1", "12", "X"), ("P2", "0012", "X"), ("P1", "13", None)],
        "werks string, matnr string, eligible string",
    )
    plants = spark.createDataFrame(
        [("P1", "N1", "R"), ("P2", "N1", None), ("P1", "N2", "R")],
        "plant_id string, business_id string, dc_region_id string",
    )
    got = dims.unit_price_avg(lines, headers, catalogue, plants, "N1", DAY)
    assert rows(got.select("item", "dc", "unit_price")) == [("12", "P1", 15.0)]


def test_unit_price_ratio(spark):
    sales = spark.createDataFrame(
        [
            (1, 5, 30.0, 2.0, day(-1)), (1, 5, 10.0, 2.0, day(-1095)), (1, 5, 99.0, 9.0, day(-1096)),
            (2, 5, 7.0, 0.0, day(0)), (0, 5, 1.0, 1.0, day(0)), (1, 0, 1.0, 1.0, day(0)),
            (9, 5, 4.0, 2.0, day(0)),
        ],
        "sku_id int, shipping_warehouse_id int, net_amt double, shipped_qty double, create_date date",
    )
    sku = spark.createDataFrame([(1, "a"), (2, "b")], "sku_id int, usn string")
    assert rows(dims.unit_price_ratio(sales, sku, DAY)) == [
        (1, "a", 5, 10.0), (2, "b", 5, 0.0), (9, None, 5, 2.0),
    ]


def test_category_alignment(spark):
    ref = spark.createDataFrame(
        [
            ("a", "b", "m", "p", None, None, None, "N1", True),
            ("a", "b", "m", "p", None, None, None, "N1", True),
            ("c", "b", "m", "p", "d", None, "s", "N1", True),
            ("e", "b", "m", "p", "d", "r", "s", "N1", False),
            ("f", "b", "m", "p", "d", "r", "s", "N2", True),
            ("g", "b", "m", "p", "d", "r", "s", "N1", None),
        ],
        "material_level1_code string, material_level2_code string, mcat_id string, pcat_id string, "
        "dmm string, reporting_merchant string, sr_merchant string, source string, is_current boolean",
    )
    got = rows(dims.category_alignment(ref, "N1"))
    assert [(r[0], r[5]) for r in got] == [("a", "Unknown"), ("c", "s")]


def test_location_map(spark):
    loc = spark.createDataFrame(
        [("3211", "12 - East"), ("3721", " 9"), ("3210", "1 - a"), ("3722", "1 - a"), ("x1", "1 - a")],
        "loc string, descr string",
    )
    assert rows(dims.location_map(loc)) == [("3211", "12"), ("3721", "9")]


def test_item_location_overrides(spark):
    extract = spark.createDataFrame(
        [("281259", "L1", "CS", "A", 2.0), ("5", "L1", "CS", None, None)],
        "item string, loc string, udc_purch_uom string, udc_velocity_code string, udc_pir_cost double",
    )
    master = spark.createDataFrame(
        [("281259", "EA", "Lamps", "11")],
        "dmdunit string, uom string, udc_merch_cat_descr string, udc_usn_number string",
    )
    sup = spark.createDataFrame([("5", "6"), ("5", None)], "item string, altitem string")
    got = rows(
        dims.item_location(extract, master, sup).select("item", "category", "usn", "uom", "altitem")
    )
    assert got == [
        ("281259", "Kitchen & Bath", "97853", "EA", None),
        ("5", None, None, "CS", "6"),
        ("5", None, None, "CS", None),
    ]


def test_instock_snapshots(spark):
    weekly = spark.createDataFrame(
        [
            ("i", "W0", "1", "N1", 1.0, 2.0), ("i", "W7", "1", "N1", 3.0, 6.0),
            ("i", "W8", "1", "N1", 50.0, 50.0), ("i", "W0", "1", "N2", 50.0, 50.0),
            ("j", "W0", "1", "N1", 1.0, 0.0),
        ],
        "item string, fiscal_week_id string, warehouse_number string, network string, "
        "numerator double, denominator double",
    )
    cal = spark.createDataFrame(
        [(day(0), "W0"), (day(-49), "W7"), (day(-56), "W8")], "date_date date, fiscal_week_id string"
    )
    got = rows(dims.instock_8w(weekly, cal, "N1", "item", DAY))
    assert got == [("i", "1", 4.0, 8.0, 0.5), ("j", "1", 1.0, 0.0, 0.0)]


def test_forecast_window_bounds_and_repeated_plants(spark):
    fcst = spark.createDataFrame(
        [
            ("L1", "i", day(0), 1.0), ("L1", "i", day(91), 2.0), ("L1", "i", day(92), 50.0),
            ("L1", "i", day(-1), 50.0), ("L2", "i", day(1), 4.0), ("L3", "i", day(1), 8.0),
            ("L1", "n", day(1), None),
        ],
        "skuloc string, item string, startdate date, qty double",
    )
    plant = spark.createDataFrame(
        [("p1", "L1", "N1"), ("p2", "L2", "N1"), ("p3", "L2", "N1"), ("p4", "L3", "N2"), ("p5", None, "N1")],
        "plant_id string, network_plant_id string, business_id string",
    )
    assert rows(dims.forecast_window(fcst, plant, "N1", DAY)) == [
        ("L1", "i", 3.0), ("L1", "n", None), ("L2", "i", 8.0),
    ]
    assert rows(dims.duplicate_keys(plant, "network_plant_id")) == [("L2", 2)]


def test_soq_first_weeks(spark):
    soq = spark.createDataFrame(
        [("p", "i", "FY25", f"FW{w:02d}", 1.0) for w in range(3, 20)]
        + [("p", "i", "FY25", "FW03", None), ("p", "i", "FY24", "FW01", 70.0), ("p", "j", "FY25", "FW04", None)],
        "plant string, item string, orderplace_fy string, orderplace_fw string, soq double",
    )
    assert rows(dims.soq_first_weeks(soq, "FY25")) == [("p", "i", "FY25", 13.0), ("p", "j", "FY25", 0.0)]


def test_high_cube_and_import(spark):
    master = spark.createDataFrame(
        [("a", 1.0, "Toilets", "1"), ("b", 2.0, "Lamps", None), ("c", 3.0, None, "2")],
        "dmdunit string, udc_pir_cost double, udc_product_cat_descr string, udc_import_type string",
    )
    assert rows(dims.high_cube(master)) == [("a", 1.0, "Toilets", "Y")]
    assert rows(dims.import_flag(master)) == [("a", "Import"), ("b", "Domestic"), ("c", "Domestic")]


def test_receipt_xref(spark):
    receipts = spark.createDataFrame(
        [("u", "1", day(-9)), ("u", "2", day(-5)), ("u", "9", day(-5))],
        "usn string, warehouse_num string, first_receive_date date",
    )
    xref = spark.createDataFrame([("u", "m1"), ("u", "m2")], "usn string, material_number string")
    plant = spark.createDataFrame([("1",), ("2",)], "plant_id string")
    moves = spark.createDataFrame(
        [("1", "P1", "Complete"), ("1", "P2", "Complete"), ("2", "P1", "Open")],
        "source_wh string, destination_wh string, current_status string",
    )
    got = rows(
        dims.receipt_xref(receipts, xref, plant, moves).select("warehouse_num", "material_number", "plant_id")
    )
    assert got == [
        ("1", "m1", "P1"), ("1", "m1", "P2"), ("1", "m2", "P1"), ("1", "m2", "P2"),
        ("2", "m1", None), ("2", "m2", None),
    ]


@pytest.mark.parametrize(
    "code, source",
    [
        ("abcon", "CON"), ("8000059C", "CON"), (None, "DIR"), ("", "DIR"), ("1SV", "DIR"),
        ("mt12T3", "12"), ("W0140TW13", "140"), ("w7t9", "7"), ("5ABC", "DIR"), ("ABCON", "DIR"),
    ],
)
def test_linehaul_branches(spark, code, source):
    items = spark.createDataFrame(
        [("u", "E1", code, 0), ("u", "E1", code, 1)], "iitem string, iwhse string, isupv string, iactv int"
    )
    whse = spark.createDataFrame([("1", "E1")], "warehouse_num string, warehouse_num_e3 string")
    assert rows(dims.linehaul(items, whse)) == [("u", "1", source)]


def test_linehaul_drops_own_warehouse(spark):
    items = spark.createDataFrame([("u", "E1", "W1T2", 0)], "iitem string, iwhse string, isupv string, iactv int")
    whse = spark.createDataFrame([("1", "E1")], "warehouse_num string, warehouse_num_e3 string")
    assert rows(dims.linehaul(items, whse)) == []


def test_warehouse_crosswalk(spark):
    names = spark.createDataFrame([("H_12x", "a"), ("H7__x", "b"), ("H123x", "c")], "name1 string, werks string")
    assert rows(dims.warehouse_crosswalk(names)) == [("12", "a"), ("123", "c"), ("7", "b")]
