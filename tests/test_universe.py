"""Golden rows of both universes on hand-made source tables."""

import datetime as dt

import pytest
from conftest import DAY, rows

from tierflow.operators import universe
from tierflow.plans import runs
from tierflow.plans.params import TierParams, material_network, usn_network
from tierflow.sources.registry import tables

PARAMS = TierParams(as_of=DAY, fiscal_year="FY2000")
EARLY, RECENT = dt.date(1999, 1, 1), DAY - dt.timedelta(weeks=13)


def frames(spark, data):
    return tables(spark, {n: spark.createDataFrame(r, s) for n, (s, r) in data.items()})


def catalogue_row(werks="P1", matnr="0012", **kw):
    base = {
        "werks": werks, "matnr": matnr, "maktx": "thing", "mcat_desc": "M", "mcat_key": "1",
        "prodcat_key": "9", "lifnr": "0077", "mtpos_mara": "NORM", "zzstocked": "Y", "eligible": "X",
    }
    return tuple((base | kw).values())


def material_tables(spark, **over):
    data = {
        "catalogue": (
            "werks string, matnr string, maktx string, mcat_desc string, mcat_key string, "
            "prodcat_key string, lifnr string, mtpos_mara string, zzstocked string, eligible string",
            [
                catalogue_row(), catalogue_row(),  # the same row twice
                catalogue_row(matnr="13"), catalogue_row(matnr="14"),
                catalogue_row(werks="P2"),  # no plant of the network
                catalogue_row(matnr="15"),  # not in the atlas
                catalogue_row(matnr="16"),
            ],
        ),
        "plant_ext": (
            "plant_id string, network_plant_id string, business_id string, dc_region_id string",
            [("P1", "P1", "N1", "R"), ("P1", "P1", "N1", "R"), ("P2", "P2", "N2", "R")],
        ),
        "plant": (
            "plant_id string, network_plant_id string, business_id string",
            [("P1", "P1", "N1"), ("P2", "P2", "N1"), ("W1", "W1", "N2")],
        ),
        "item_master": (
            "dmdunit string, uom string, udc_merch_cat_descr string, udc_usn_number string, "
            "udc_product_cat_descr string, udc_import_type string, udc_pir_cost double",
            [("12", "EA", "M", "u", "Foil", "1", 1.0)],
        ),
        "supersession": ("item string, altitem string", [("12", "99"), ("13", None)]),
        "extract": (
            "item string, loc string, udc_purch_uom string, udc_velocity_code string, udc_pir_cost double",
            [("12", "P1", "CS", "B", 2.0), ("13", "P1", "CS", None, None)],
        ),
        "atlas": (
            "plant string, material string, vendor string",
            [("P1", "0012", "v1"), ("P1", "0012", "v2"), ("P1", "13", "v1"), ("P1", "014", "v1"),
             ("P1", "16", "v1")],
        ),
        "vendor_receipts": (
            "material_nbr string, plant string, vendor_nbr string, vendor_sku_dc_first_receive_date date",
            [("0012", "P1", "v1", EARLY), ("14", "P1", "v1", EARLY), ("16", "P1", "v1", RECENT)],
        ),
        "order_lines": (
            "vbeln string, matnr string, zdel_ready string, pstyv string, abgru string, vstel string, "
            "zim_date string, netpr double",
            [("o", "0012", "Y", "ZT", None, None, "20000101", 8.0)],
        ),
        "order_headers": ("vbeln string, zzdef_werks string, auart string", [("o", "P1", "ZOR")]),
        "instock_weekly": (
            "item string, sku_id int, warehouse_number string, fiscal_week_id string, network string, "
            "numerator double, denominator double",
            [("12", 1, "P1", "W", "N1", 1.0, 4.0), ("13", 1, "P1", "W", "N1", 1.0, 0.0)],
        ),
        "calendar": ("date_date date, fiscal_week_id string", [(DAY, "W")]),
        "usn_receipts": (
            "usn string, warehouse_num string, first_receive_date date",
            [("u13", "W1", EARLY), ("u14", "W1", RECENT)],
        ),
        "item_xref": ("usn string, material_number string", [("u13", "0013"), ("u14", "14")]),
        "warehouse_moves": (
            "source_wh string, destination_wh string, current_status string", [("W1", "P1", "Complete")],
        ),
        "forecast": (
            "skuloc string, item string, startdate date, qty double",
            [("P1", "12", DAY, 26.0), ("P1", "13", DAY, 13.0)],
        ),
        "soq": (
            "plant string, item string, orderplace_fy string, orderplace_fw string, soq double",
            [("P1", "12", "FY2000", "FW01", 3.0)],
        ),
    }
    return frames(spark, data | over)


COLUMNS = ["item", "sku_status", "receipt_date", "superseded_sku", "cogs", "retail_price", "instock_rate",
           "system_velocity", "proposed_velocity", "first_receipt_flg"]


def test_material_universe_modes_and_fan_out(spark):
    t = material_tables(spark)
    plain = universe.universe_material(t, PARAMS, material_network(status_mode="no_receipt"))
    # item 12 has two vendors, one of them with a receipt: both rows stay
    assert rows(plain.select(*COLUMNS)) == [
        ("12", "New", None, "superseded", 2.0, 8.0, 0.25, "B", "C", "No First Receipt"),
        ("12", "Not New", EARLY, "superseded", 2.0, 8.0, 0.25, "B", "E", "First Receipt"),
        ("13", "New", None, "not superseded", 0.0, None, 0.0, None, "C", "No First Receipt"),
        ("14", "New", None, "not superseded", 0.0, None, 0.0, None, "C", "No First Receipt"),
        ("16", "Not New", RECENT, "not superseded", 0.0, None, 0.0, None, "E", "First Receipt"),
    ]
    crossed = universe.universe_material(t, PARAMS, material_network(status_mode="coalesced"))
    status = {(r["item"], r["sku_status"]) for r in crossed.collect()}
    assert status == {("12", "New"), ("12", "Not New"), ("13", "Not New"), ("14", "Not New"), ("16", "Not New")}
    recent = universe.universe_material(t, PARAMS, material_network(status_mode="recent"))
    rule = {(r["item"], r["sku_status"], r["first_receipt_flg"]) for r in recent.collect()}
    assert ("16", "New", "First Receipt") in rule


def test_coalesced_without_cross_receipts_is_the_plain_rule(spark):
    schema = "usn string, warehouse_num string, first_receive_date date"
    t = material_tables(spark, usn_receipts=(schema, []))
    plain, crossed = (
        universe.universe_material(t, PARAMS, material_network(status_mode=m)) for m in ("no_receipt", "coalesced")
    )
    assert rows(plain) == rows(crossed)


@pytest.mark.parametrize(
    "change, kept",
    [
        ({}, True), ({"werks": "GA07"}, False), ({"werks": "ZZ01"}, False), ({"lifnr": "00028126"}, False),
        ({"lifnr": "0000"}, False), ({"lifnr": None}, False), ({"mtpos_mara": "ZNFS"}, False),
        ({"mcat_key": "29"}, False), ({"mcat_key": None}, False), ({"prodcat_key": "103101"}, False),
    ],
)
def test_material_policy(spark, change, kept):
    t = material_tables(spark)
    df = spark.createDataFrame([catalogue_row(**change)], t["catalogue"].schema)
    flag = universe.is_filtered_out(universe.material_kept(material_network()))
    assert df.select(flag).first()[0] is not kept


def test_whole_material_run(spark):
    got = runs.reclassify(material_tables(spark), PARAMS, material_network(), "material")
    picked = rows(
        got.select("jda_item", "is_forecasted", "new_proposed_velocity", "calculated_velocity_percentile",
                   "proposed_sscov", "current_total_soq_13_weeks", "pcat", "velocity_change_class")
    )
    assert picked == [
        ("12", "Forecasted", "A", 0.0, 4, 3.0, "Foil", "Promotion"),
        ("12", "Forecasted", "A", 0.0, 4, 3.0, "Foil", "Promotion"),
        ("13", "Forecasted", "D", 1.0, 0, 0.0, None, "Unclassified"),
        ("14", "Not Forecasted", "E", None, 0, 0.0, None, "Unclassified"),
        ("16", "Not Forecasted", "E", None, 0, 0.0, None, "Unclassified"),
    ]


def usn_tables(spark):
    data = {
        "assortment": (
            "warehouse_number string, usn string, item_description string, ipr_category string",
            [("1", "a", "A", "Replenished"), ("2", "a", "A", "REPLENISHED"), ("1", "b", "B", "other"),
             ("1", "c", "C", "replenished"), ("701", "a", "A", "replenished"), ("3", "a", "A", "replenished")],
        ),
        "calendar": ("date_date date, fiscal_week_id string", [(DAY, "W"), (DAY, "W")]),
        "inventory_master": (
            "usn string, warehouse_number string",
            [("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"), ("a", "701"), ("a", "3")],
        ),
        "dim_warehouse": ("warehouse_num string, warehouse_id int", [("1", 1), ("2", 2), ("701", 701), ("3", 3)]),
        "warehouse": ("warehouse_id int, is_open_for_operations int", [(1, 1), (2, 0), (701, 1), (3, 1)]),
        "sku": ("sku_id int, taxonomy_id int, usn string", [(10, 5, "a"), (11, 5, "a"), (12, 5, "b"), (13, 6, "c")]),
        "taxonomy": ("taxonomy_id int", [(5,), (5,), (6,)]),
        "open_warehouse": (
            "warehouse_id int, warehouse_num string, region_name string, is_open_for_operations boolean",
            [(1, "1", "VMI", True), (2, "2", "East", False)],
        ),
        "plant_names": ("name1 string, werks string", [("H_1_", "L1")]),
        "location": ("loc string, descr string", [("3212", "1 - one"), ("3213", "2 - two")]),
        "sales": (
            "sku_id int, shipping_warehouse_id int, net_amt double, shipped_qty double, create_date date",
            [(10, 1, 10.0, 2.0, DAY), (11, 1, 9.0, 3.0, DAY)],
        ),
        "usn_receipts": (
            "usn string, warehouse_num string, first_receive_date date",
            [("a", "1", RECENT), ("a", "2", EARLY)],
        ),
        "instock_weekly": (
            "item string, sku_id int, warehouse_number string, fiscal_week_id string, network string, "
            "numerator double, denominator double",
            [("x", 10, "1", "W", "N2", 1.0, 2.0)],
        ),
        "extract": (
            "item string, loc string, udc_purch_uom string, udc_velocity_code string, udc_pir_cost double",
            [("12", "L1", "CS", "B", 2.0), ("12", "3213", "CS", "C", 3.0)],
        ),
        "item_master": (
            "dmdunit string, uom string, udc_merch_cat_descr string, udc_usn_number string", [("12", None, "M", "a")],
        ),
        "supersession": ("item string, altitem string", [("12", "99")]),
    }
    return frames(spark, data)


def test_usn_universe(spark):
    got = universe.universe_usn(usn_tables(spark), PARAMS, usn_network())
    picked = rows(
        got.select("dc", "usn", "location", "item", "uom", "sku_status", "first_receipt_flg", "cogs",
                   "retail_price", "instock_rate", "is_vmi", "is_active", "is_filtered_out")
    )
    one = ("1", "a", "L1", "12", "CS", "New", "First Receipt", 2.0)
    assert picked == [
        # two skus of one usn, and two prices joined by usn
        (*one, 3.0, 0.0, True, True, False), (*one, 3.0, 0.5, True, True, False),
        (*one, 5.0, 0.0, True, True, False), (*one, 5.0, 0.5, True, True, False),
        ("1", "b", "L1", None, None, "New", "No First Receipt", 0.0, None, 0.0, True, False, False),
        ("2", "a", "3213", "12", "CS", "Not New", "First Receipt", 3.0, None, 0.0, False, True, True),
        ("3", "a", None, None, None, "New", "No First Receipt", 0.0, None, 0.0, False, True, False),
        ("701", "a", None, None, None, "New", "No First Receipt", 0.0, None, 0.0, False, True, True),
    ]


def test_usn_universe_needs_the_day_on_the_calendar(spark):
    later = TierParams(as_of=DAY + dt.timedelta(days=1), fiscal_year="FY2000")
    assert universe.universe_usn(usn_tables(spark), later, usn_network()).count() == 0


def test_unknown_status_mode():
    with pytest.raises(ValueError):
        material_network(status_mode="whenever")
