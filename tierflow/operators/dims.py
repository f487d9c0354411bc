"""Dimension and fact preparation: one function per derived input of the universe."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions import div0, exact_sums, next_weekday, previous_weekday, zero_trim
from tierflow.operators.joins import first_row
from tierflow.plans import policy
from tierflow.sources.registry import stage


def calendar_info(calendar: DataFrame, as_of: dt.date) -> DataFrame:
    """Fiscal week of the day with the Monday before it and the Sunday after it."""
    day = F.lit(as_of)
    return calendar.filter(F.col("date_date") == day).select(
        "fiscal_week_id",
        previous_weekday(day, "MON").alias("week_begin"),
        next_weekday(day, "SUN").alias("week_end"),
    )


def vendor_team(relations: DataFrame) -> DataFrame:
    """One row per raw vendor: that of its first analyst by name, nulls last.

    '0123' and '123' stay two vendors here.
    """
    order = [F.col("inventory_analyst").asc_nulls_last(), F.col("manager").asc_nulls_first()]
    first = first_row(relations.select("vendor", "inventory_analyst", "manager"), ["vendor"], order)
    return first.withColumn("vendor", zero_trim("vendor"))


def unit_price_avg(
    lines: DataFrame,
    headers: DataFrame,
    catalogue: DataFrame,
    plants: DataFrame,
    network: str,
    as_of: dt.date,
    days: int = 730,
) -> DataFrame:
    """Average order price by (item, dc) over the recent, deliverable order lines.

    Lines are summed by material and dc before they meet the catalogue, so that a
    busy material is one row there; repeated catalogue rows weigh sum and count alike. The
    sums by material are written, for the sums by item read them twice.
    """
    live_plants = plants.filter(
        (F.col("business_id") == network) & F.col("dc_region_id").isNotNull()
    ).select(F.col("plant_id").alias("zzdef_werks"))
    kept_headers = (
        headers.filter(F.col("auart").isin(*policy.PRICE_ORDER_TYPES))
        .join(live_plants, "zzdef_werks", "left_semi")
        .select("vbeln", F.col("zzdef_werks").alias("dc"))
    )
    kept_lines = lines.filter(
        (F.col("zdel_ready") == "Y")
        & ~F.col("pstyv").isin(*policy.PRICE_EXCLUDED_LINE_CATEGORIES)
        & F.coalesce("abgru", F.lit("")).isin(*policy.PRICE_REJECT_CODES)
        & ~F.coalesce("vstel", F.lit("")).isin(*policy.PRICE_EXCLUDED_SHIP_POINTS)
        & (F.try_to_date("zim_date", "yyyyMMdd") >= F.date_sub(F.lit(as_of), days))
    ).select("vbeln", "matnr", "netpr")
    eligible = catalogue.filter(F.col("eligible") == "X").select(
        "matnr", F.col("werks").alias("dc")
    )
    priced = F.col("netpr").isNotNull().cast("long")
    by_material = exact_sums(
        kept_lines.join(kept_headers, "vbeln"), ["matnr", "dc"], {"amount": "netpr"}, {"lines": priced}
    ).join(eligible, ["matnr", "dc"])
    item = zero_trim("matnr").alias("item")
    by_item = exact_sums(stage(by_material, "priced-materials"), [item, "dc"], {"amount": "amount"}, {"lines": "lines"})
    price = F.col("amount") / F.nullif(F.col("lines"), F.lit(0))
    return by_item.select("item", "dc", price.alias("unit_price"))


def unit_price_ratio(
    sales: DataFrame, sku: DataFrame, as_of: dt.date, days: int = 1095
) -> DataFrame:
    """Net amount over shipped quantity by (sku, usn, warehouse).

    Sales are summed before the usn is looked up. A sku listed twice under one
    usn would double both sums, so its ratio is that of one listing.
    """
    recent = sales.filter(
        (F.col("sku_id") != 0)
        & (F.col("shipping_warehouse_id") != 0)
        & (F.col("create_date") >= F.date_sub(F.lit(as_of), days))
    )
    sums = {"amount": "net_amt", "shipped": "shipped_qty"}
    return (
        exact_sums(recent, ["sku_id", "shipping_warehouse_id"], sums)
        .withColumn("unit_price", div0("amount", "shipped"))
        .join(sku.select("sku_id", "usn").distinct(), "sku_id", "left")
        .select("sku_id", "usn", "shipping_warehouse_id", "unit_price")
    )


def category_alignment(categories: DataFrame, network: str) -> DataFrame:
    """Current category codes of the network with their merchant."""
    return (
        categories.filter((F.col("source") == network) & F.col("is_current"))
        .select(
            "material_level1_code",
            "material_level2_code",
            "mcat_id",
            "pcat_id",
            "dmm",
            F.coalesce("reporting_merchant", "sr_merchant", "dmm", F.lit("Unknown")).alias(
                "merchant"
            ),
        )
        .distinct()
    )


def location_map(
    locations: DataFrame,
    lo: int = policy.LOCATION_RANGE[0],
    hi: int = policy.LOCATION_RANGE[1],
) -> DataFrame:
    """Locations numbered lo to hi with the dc named before the first dash."""
    number = F.col("loc").try_cast("decimal(38,0)")
    return locations.filter(number.between(lo, hi)).select(
        "loc", F.trim(F.split_part("descr", F.lit("-"), F.lit(1))).alias("dc")
    )


def item_location(
    extract: DataFrame,
    item_master: DataFrame,
    supersession: DataFrame,
    overrides: tuple[tuple[str, str, str], ...] = policy.ITEM_OVERRIDES,
) -> DataFrame:
    """System rows of each item and location with master data and alternate item."""
    master = item_master.select(
        F.col("dmdunit").alias("item"), "uom", "udc_merch_cat_descr", "udc_usn_number"
    )
    category, usn = F.col("udc_merch_cat_descr"), _usn(overrides)
    for item, fixed_category, _ in overrides:
        category = F.when(F.col("item") == item, F.lit(fixed_category)).otherwise(category)
    return (
        extract.join(master, "item", "left")
        .join(supersession.select("item", "altitem"), "item", "left")
        .select(
            "loc",
            "item",
            category.alias("category"),
            usn.alias("usn"),
            F.coalesce("uom", "udc_purch_uom").alias("uom"),
            "altitem",
            "udc_pir_cost",
            "udc_velocity_code",
        )
    )


def _usn(overrides: tuple[tuple[str, str, str], ...]) -> Column:
    usn = F.col("udc_usn_number")
    for item, _, fixed_usn in overrides:
        usn = F.when(F.col("item") == item, F.lit(fixed_usn)).otherwise(usn)
    return usn


def item_usns(
    item_master: DataFrame, overrides: tuple[tuple[str, str, str], ...] = policy.ITEM_OVERRIDES
) -> DataFrame:
    """Distinct usns of each item, as ``item_location`` has them."""
    known = item_master.select(F.col("dmdunit").alias("item"), "udc_usn_number")
    types = dict(known.dtypes)
    # an override holds for items that the master lacks, too
    for item, _, _ in overrides:
        row = [F.lit(item).cast(types["item"]).alias("item"), F.lit(None).cast(types["udc_usn_number"]).alias("udc_usn_number")]
        known = known.unionByName(known.sparkSession.range(1).select(*row))
    return known.select("item", _usn(overrides).alias("usn")).where("item is not null and usn is not null").distinct()


def instock_8w(
    weekly: DataFrame,
    calendar: DataFrame,
    network: str,
    key: str,
    as_of: dt.date,
    weeks: int = 8,
) -> DataFrame:
    """In-stock units over the last weekly snapshots by (key, warehouse)."""
    days = [as_of - dt.timedelta(days=7 * k) for k in range(weeks)]
    snapshots = calendar.filter(F.col("date_date").isin(*days)).select("fiscal_week_id")
    kept = weekly.filter(F.col("network") == network).join(snapshots, "fiscal_week_id")
    sums = {"instock_numerator": "numerator", "instock_denominator": "denominator"}
    return (
        exact_sums(kept, [key, "warehouse_number"], sums)
        .withColumn("instock_rate", div0("instock_numerator", "instock_denominator"))
    )


def forecast_window(
    forecast: DataFrame, plant: DataFrame, network: str, as_of: dt.date, weeks: int = 13
) -> DataFrame:
    """Forecast quantity by (location, item) from the day to ``weeks`` weeks on, both included."""
    horizon = as_of + dt.timedelta(weeks=weeks)
    locations = plant.filter(F.col("business_id") == network).select(
        F.col("network_plant_id").alias("skuloc")
    )
    kept = forecast.filter(F.col("startdate").between(F.lit(as_of), F.lit(horizon)))
    location = F.col("skuloc").alias("location")
    # by item first, as the universe's rows lie, so that these sums and not those rows are moved
    sums = exact_sums(kept.join(locations, "skuloc"), ["item", location], {"total_forecasted_qty": "qty"})
    return sums.select("location", "item", "total_forecasted_qty")


def soq_first_weeks(projections: DataFrame, fiscal_year: str, n: int = 13) -> DataFrame:
    """Projected order quantity by (plant, item) over the year's first n weeks on file."""
    week = F.right("orderplace_fw", F.lit(2)).cast("int")
    year = projections.filter(F.col("orderplace_fy") == fiscal_year)
    first_weeks = (
        year.select("orderplace_fw")
        .distinct()
        .select(week.alias("week_num"))
        .orderBy(F.col("week_num").asc_nulls_last())
        .limit(n)
    )
    # at most n one-column rows, so this side is always small enough to broadcast
    return (
        year.withColumn("week_num", week)
        .join(F.broadcast(first_weeks), "week_num", "left_semi")
        .groupBy("plant", "item", "orderplace_fy")
        .agg(F.sum(F.coalesce("soq", F.lit(0.0))).alias("total_soq"))
    )


def high_cube(
    item_master: DataFrame, categories: tuple[str, ...] = policy.HIGH_CUBE_CATEGORIES
) -> DataFrame:
    """Items of the bulky product categories."""
    return item_master.filter(F.col("udc_product_cat_descr").isin(*categories)).select(
        F.col("dmdunit").alias("item"),
        F.col("udc_pir_cost").alias("cost"),
        F.col("udc_product_cat_descr").alias("pcat"),
        F.lit("Y").alias("high_cube_flg"),
    )


def import_flag(item_master: DataFrame) -> DataFrame:
    """Import or Domestic for each item; an unknown type is domestic."""
    return item_master.select(
        F.col("dmdunit").alias("item"),
        F.when(F.col("udc_import_type") == "1", "Import").otherwise("Domestic").alias(
            "import_flag"
        ),
    )


def receipt_xref(
    receipts: DataFrame, item_xref: DataFrame, plant: DataFrame, moves: DataFrame
) -> DataFrame:
    """First receipts of the usn network under their material number and new plant.

    A receipt whose warehouse has no completed move keeps a null plant.
    """
    done = moves.filter(F.col("current_status") == policy.MOVE_COMPLETE).select(
        F.col("source_wh").alias("warehouse_num"), "destination_wh"
    )
    return (
        receipts.join(plant.select(F.col("plant_id").alias("warehouse_num")), "warehouse_num")
        .join(done, "warehouse_num", "left")
        .join(item_xref.select("usn", "material_number"), "usn")
        .select(
            "usn",
            "warehouse_num",
            F.col("first_receive_date").alias("cross_receipt_date"),
            "material_number",
            F.col("destination_wh").alias("plant_id"),
        )
    )


def linehaul(supplier_items: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Source warehouse of each active (usn, destination), read from the supplier code."""
    code = F.col("isupv")
    upper = F.upper(code)
    consolidated = code.contains("con") | code.isin(*policy.CONSOLIDATED_SUPPLIERS)
    direct = code.isNull() | (code == "") | code.contains("SV")
    source = (
        F.when(consolidated, "CON")
        .when(direct, "DIR")
        .when(upper.startswith("MT"), F.split_part(upper, F.lit("T"), F.lit(2)))
        .when(
            F.ltrim(upper, F.lit("WX0")) != code,
            F.ltrim(F.split_part(upper, F.lit("T"), F.lit(1)), F.lit("WX0")),
        )
        .otherwise("DIR")
    )
    # repeated lines go before the codes are read and the warehouse is looked up
    active = supplier_items.filter(F.col("iactv") == 0).select("iitem", "iwhse", "isupv").distinct()
    return (
        active.join(
            warehouses.select(
                F.col("warehouse_num_e3").alias("iwhse"),
                F.col("warehouse_num").alias("destination_plant"),
            ),
            "iwhse",
        )
        .select(F.col("iitem").alias("usn"), "destination_plant", source.alias("source_plant"))
        .filter(F.col("source_plant") != F.col("destination_plant"))
        .distinct()
    )


def warehouse_crosswalk(plant_names: DataFrame) -> DataFrame:
    """Warehouse number, cut from the plant's name, to plant id."""
    return plant_names.select(
        F.trim(F.substring("name1", 2, 3), F.lit("_")).alias("warehouse_num"),
        F.col("werks").alias("plant_id"),
    )


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Data-quality count: non-null keys that occur more than once, with their rows.

    Joins on such keys repeat rows, and so shift sums and percentiles.
    """
    filled = df
    for k in keys:
        filled = filled.filter(F.col(k).isNotNull())
    return filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
