"""Universe of (dc, item) rows for the two networks, and the flags on them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions import div0null, zero_trim
from tierflow.operators import dims
from tierflow.operators.joins import few_valued_join, lookup_join
from tierflow.plans import policy
from tierflow.plans.params import NetworkPolicy, TierParams
from tierflow.sources.registry import stage

UNIVERSE_COLUMNS = (
    "network",
    "dc",
    "location",
    "mcat",
    "item",
    "sku",
    "material_id",
    "material_number",
    "usn",
    "sku_description",
    "uom",
    "superseded_sku",
    "sku_status",
    "receipt_date",
    "retail_price",
    "cogs",
    "instock_numerator",
    "instock_denominator",
    "instock_rate",
    "system_velocity",
    "proposed_velocity",
    "is_vmi",
    "is_active",
    "is_filtered_out",
    "first_receipt_flg",
)


# ---- flags ---------------------------------------------------------------------------------


def is_new(receipt: str, mode: str, as_of: dt.date, weeks: int = 13) -> Column:
    """New under the rule: never received, or under 'recent' received in the last weeks."""
    missing = F.col(receipt).isNull()
    if mode == "recent":
        return missing | (F.col(receipt) >= F.lit(as_of - dt.timedelta(weeks=weeks)))
    return missing


def sku_status(receipt: str, mode: str, as_of: dt.date, weeks: int = 13) -> Column:
    return F.when(is_new(receipt, mode, as_of, weeks), "New").otherwise("Not New")


def default_tier(receipt: str, mode: str, as_of: dt.date, weeks: int = 13) -> Column:
    return F.when(is_new(receipt, mode, as_of, weeks), "C").otherwise("E")


def receipt_date(mode: str, own: str, cross: str) -> Column:
    """Date that counts as first receipt; only 'coalesced' looks across networks."""
    return F.coalesce(own, cross) if mode == "coalesced" else F.col(own)


def first_receipt_flag(receipt: str) -> Column:
    """Whether any receipt date exists; under 'recent' not the same as the status."""
    return F.when(F.col(receipt).isNull(), "No First Receipt").otherwise("First Receipt")


def superseded_flag(altitem: str) -> Column:
    return F.when(F.col(altitem).isNotNull(), "superseded").otherwise("not superseded")


def material_active() -> Column:
    return (F.col("zzstocked") == "Y") & (F.col("eligible") == "X")


def material_kept(net: NetworkPolicy) -> Column:
    """Catalogue row inside the policy; null, so not kept, when any part is null."""
    return (
        ~F.col("werks").isin(*net.excluded_plants)
        & (F.left("werks", F.lit(len(net.excluded_plant_prefix))) != net.excluded_plant_prefix)
        & ~zero_trim("lifnr").isin(*net.excluded_vendors)
        & (F.col("mtpos_mara") != net.excluded_item_type)
        & ~F.col("mcat_key").isin(*net.excluded_category_keys)
        & ~F.col("prodcat_key").isin(*net.excluded_product_keys)
    )


def usn_active() -> Column:
    return (F.col("sku_id") != 0) & (F.upper("ipr_category") == policy.ACTIVE_ASSORTMENT)


def usn_kept(net: NetworkPolicy) -> Column:
    return ~F.col("warehouse_number").isin(*net.excluded_warehouses) & (
        F.col("is_open_for_operations") == 1
    )


def is_active(active: Column) -> Column:
    return F.when(active, True).otherwise(False)


def is_filtered_out(kept: Column) -> Column:
    return F.when(kept, False).otherwise(True)


def is_vmi(regions: tuple[str, ...] = ()) -> Column:
    """Vendor-managed: never in the material network, by region in the usn network."""
    if not regions:
        return F.lit(False)
    return F.when(F.col("region_name").isin(*regions), True).otherwise(False)


# ---- network of material numbers ------------------------------------------------------------


def universe_material(
    tables: Mapping[str, DataFrame],
    params: TierParams,
    net: NetworkPolicy,
    active_only: bool = False,
    item_list: DataFrame | None = None,
    place_list: DataFrame | None = None,
    all_dates: bool = False,
) -> DataFrame:
    """Distinct catalogue rows of the network with status, cost, price, stock and tier.

    Tables that only have to hold a key are semi-joined. The wide catalogue rows are shuffled
    once, by (item, dc): copies go there, all joins are on that key, and the final distinct
    shares it. What hangs on the item alone comes with the narrow receipt rows, which
    each catalogue row has to meet. Receipts are cut to their distinct dates, for nothing
    else of them is read. ``active_only`` applies the active and policy
    conditions on the catalogue scan; the forecast attach, which follows it, makes
    the rows distinct, so it is not done here as well. ``item_list`` and ``place_list``
    hold one row per item, or per (item, dc), with a list that the rows carry along.

    With ``all_dates`` the rows serve every status rule: they carry their own and cross receipt
    dates as lists, which ``with_receipts`` unfolds, and no receipt, status or tier yet. Each
    joined table is made distinct on what the rows take from it, so active rows are distinct as
    they are, and no joined wide row is grouped. They lie in as many parts as
    the catalogue's size asks for, so a task's rows do not grow with the input.
    """
    t = tables
    place = ["item", "dc"]
    catalogue = t["catalogue"]
    if active_only:
        catalogue = catalogue.filter(material_active() & material_kept(net))
    parts = _place_parts(t["catalogue"]) if all_dates else None
    own_plants = t["plant_ext"].filter(F.col("business_id") == net.network)
    base = (
        catalogue.select(
            F.col("werks").alias("dc"),
            zero_trim("matnr").alias("item"),
            F.col("matnr").alias("material_id"),
            F.col("mcat_desc").alias("mcat"),
            F.col("maktx").alias("sku_description"),
            is_active(material_active()).alias("is_active"),
            is_filtered_out(material_kept(net)).alias("is_filtered_out"),
        )
        .where("item is not null")
        .join(own_plants.select(F.col("network_plant_id").alias("dc")), "dc", "left_semi")
        .join(t["plant"].select(F.col("plant_id").alias("dc")), "dc", "left_semi")
        .transform(_placed, place, parts)
        .distinct()
    )
    units = t["item_master"].select(F.col("dmdunit").alias("item"), "uom")
    superseded = (
        t["supersession"]
        .select("item", superseded_flag("altitem").alias("superseded_sku"))
        .distinct()
    )
    listed = (
        t["atlas"]
        .select(zero_trim("material").alias("item"), F.col("plant").alias("dc"), "material", "vendor")
        .where("item is not null and dc is not null")
        .join(units, "item", "left")
        .join(superseded, "item", "left")
    )
    if item_list is not None:
        listed = listed.join(item_list, "item", "left")
    if all_dates:
        listed = listed.withColumn("superseded_sku", F.coalesce("superseded_sku", F.lit("not superseded")))
    if parts:
        listed = _placed(listed, place, parts)
    own_receipts = _own_receipts(listed, t["vendor_receipts"], unique=not all_dates)
    extract = t["extract"].select(
        "item", F.col("loc").alias("dc"), "udc_pir_cost", "udc_velocity_code"
    )
    if all_dates:
        # the lists hold a date once, so equal rows need not go first
        own_receipts = _date_list(own_receipts, "own_receipt_date", policy.OWN_DATES)
        cost = F.coalesce("udc_pir_cost", F.lit(0.0)).alias("udc_pir_cost")
        extract = _placed(extract.select(*place, cost, "udc_velocity_code"), place, parts).distinct()
    prices = dims.unit_price_avg(
        t["order_lines"],
        t["order_headers"],
        t["catalogue"],
        t["plant_ext"],
        net.network,
        params.as_of,
        params.line_price_days,
    )
    stock = dims.instock_8w(
        t["instock_weekly"], t["calendar"], net.network, "item", params.as_of, params.snapshot_weeks
    ).withColumnRenamed("warehouse_number", "dc")

    rows = (
        base.join(own_receipts, place)
        .join(extract, place, "left")
        .join(prices, place, "left")
        .join(stock.drop("instock_rate"), place, "left")
    )
    if all_dates or net.status_mode == "coalesced":
        cross = (
            dims.receipt_xref(
                t["usn_receipts"], t["item_xref"], t["plant"], t["warehouse_moves"]
            )
            .filter(F.col("plant_id").isNotNull())
            .select(
                zero_trim("material_number").alias("item"),
                F.col("plant_id").alias("dc"),
                "cross_receipt_date",
            )
            .transform(_placed, place, parts)
        )
        if all_dates:
            cross = _date_list(cross, "cross_receipt_date", policy.CROSS_DATES)
        else:
            cross = cross.distinct()
        rows = rows.join(cross, place, "left")
    else:
        rows = rows.withColumn("cross_receipt_date", F.lit(None).cast("date"))
    if place_list is not None:
        rows = rows.join(place_list, place, "left")
    lists = [c for x in (item_list, place_list) if x is not None for c in x.columns if c not in place]
    if all_dates:
        lists += [policy.OWN_DATES, policy.CROSS_DATES]
        date = F.lit(None).cast("date")
    else:
        date = receipt_date(net.status_mode, "own_receipt_date", "cross_receipt_date")
    rows = rows.withColumn("receipt_date", date)
    no_text = F.lit(None).cast("string")
    rows = rows.withColumns(
        {
            "network": F.lit(net.network),
            "location": F.col("dc"),
            "sku": F.col("item"),
            "material_number": no_text,
            "usn": no_text,
            "superseded_sku": F.coalesce("superseded_sku", F.lit("not superseded")),
            "sku_status": _status(params, net),
            "retail_price": F.col("unit_price"),
            "cogs": F.coalesce("udc_pir_cost", F.lit(0.0)),
            "instock_rate": div0null("instock_numerator", "instock_denominator"),
            "system_velocity": F.col("udc_velocity_code"),
            "proposed_velocity": default_tier(
                "receipt_date", net.status_mode, params.as_of, params.recent_weeks
            ),
            "is_vmi": is_vmi(),
            "first_receipt_flg": first_receipt_flag("receipt_date"),
        }
    ).select(*UNIVERSE_COLUMNS, *lists)
    if all_dates:
        rows = rows.withColumns({c: no_text for c in ("sku_status", "proposed_velocity", "first_receipt_flg")})
    return rows if active_only else rows.distinct()


def _place_parts(catalogue: DataFrame) -> int | None:
    """Number of parts that keeps one below ``policy.ROWS_PER_PART`` rows; None where few rows leave it to Spark.

    Spark sizes the parts by compressed bytes, or deals any input over a fixed number, while the
    joins by place sort ten tables in one task; so the memory of that task grew with the input.
    """
    rows = catalogue.count()
    if rows <= policy.FEW_ROWS:
        return None
    default = int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(default, -(-rows // policy.ROWS_PER_PART))


def _placed(df: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def _date_list(rows: DataFrame, date: str, name: str) -> DataFrame:
    """One row per other columns with the sorted list of their dates, null being a date and the first."""
    others = [c for c in rows.columns if c != date]
    listed = F.sort_array(F.collect_set(F.struct(date)))
    return rows.groupBy(*others).agg(listed.getField(date).alias(name))


def with_receipts(rows: DataFrame, params: TierParams, net: NetworkPolicy) -> DataFrame:
    """Active rows that carry all receipt dates, once for each date that counts under the rule.

    A list holds a date once, so the rows are distinct without a shuffle.
    """
    dates = own = F.col(policy.OWN_DATES)
    if net.status_mode == "coalesced":
        # the cross dates stand for an own date that is null; set functions, unlike lambdas, are compiled
        none = F.array(F.lit(None).cast("date"))
        crossed = F.array_union(F.array_except(own, none), F.coalesce(policy.CROSS_DATES, none))
        dates = F.when(F.get(own, 0).isNull(), crossed).otherwise(own)
    kept = [c for c in rows.columns if c not in (policy.OWN_DATES, policy.CROSS_DATES)]
    one = rows.withColumn("receipt_date", F.explode(dates))
    return one.withColumns(
        {"sku_status": _status(params, net), "first_receipt_flg": first_receipt_flag("receipt_date")}
    ).select(*kept)


def _own_receipts(listed: DataFrame, receipts: DataFrame, unique: bool = True) -> DataFrame:
    """Listed (item, dc) rows with each of their vendors' receipt dates, null without any.

    The item is cut from the material, so rows of one material and plant share their (item, dc)
    too. The join is placed by that key, as all that follow; material and vendor are
    compared by two inequalities each, for an equality would become part of the placing.
    """
    dated = receipts.select(
        F.col("plant").alias("r_dc"),
        F.col("material_nbr").alias("r_material"),
        F.col("vendor_nbr").alias("r_vendor"),
        F.col("vendor_sku_dc_first_receive_date").alias("own_receipt_date"),
    ).where("r_material is not null and r_dc is not null")
    same = (F.col("item") == zero_trim("r_material")) & (F.col("dc") == F.col("r_dc"))
    for k in ("material", "vendor"):
        same = same & (F.col(k) <= F.col(f"r_{k}")) & (F.col(k) >= F.col(f"r_{k}"))
    rows = listed.join(dated, same, "left").drop("material", "vendor", "r_dc", "r_material", "r_vendor")
    return rows.distinct() if unique else rows


def _status(params: TierParams, net: NetworkPolicy) -> Column:
    return sku_status("receipt_date", net.status_mode, params.as_of, params.recent_weeks)


# ---- network of usn numbers -----------------------------------------------------------------


def usn_warehouses(
    tables: Mapping[str, DataFrame], params: TierParams, net: NetworkPolicy
) -> DataFrame:
    """Warehouses with id, open code, region and location; none if the day is on no calendar.

    A location comes from the plant's name where the warehouse runs, else from its number.
    """
    t = tables
    running = (
        t["open_warehouse"]
        .filter(F.col("is_open_for_operations"))
        .select("warehouse_id", F.col("warehouse_num").alias("open_num"), "region_name")
    )
    crosswalk = dims.warehouse_crosswalk(t["plant_names"]).select(
        F.col("warehouse_num").alias("open_num"), F.col("plant_id").alias("named_location")
    )
    locations = dims.location_map(t["location"], *net.location_range).select(
        F.col("dc").alias("warehouse_number"), F.col("loc").alias("numbered_location")
    )
    # any number of rows of the day gives the same warehouses
    today = (
        t["calendar"].filter(F.col("date_date") == F.lit(params.as_of)).select("date_date").limit(1)
    )
    return (
        t["dim_warehouse"]
        .select(
            F.col("warehouse_num").alias("warehouse_number"),
            "warehouse_id",
            F.lit(params.as_of).alias("date_date"),
        )
        .join(today, "date_date", "left_semi")
        .join(t["warehouse"].select("warehouse_id", "is_open_for_operations"), "warehouse_id")
        .join(running, "warehouse_id", "left")
        .join(crosswalk, "open_num", "left")
        .join(locations, "warehouse_number", "left")
        .select(
            "warehouse_number",
            "warehouse_id",
            "is_open_for_operations",
            "region_name",
            F.coalesce("named_location", "numbered_location").alias("location"),
        )
        .distinct()
    )


def universe_usn(
    tables: Mapping[str, DataFrame],
    params: TierParams,
    net: NetworkPolicy,
    active_only: bool = False,
    item_list: DataFrame | None = None,
    place_list: DataFrame | None = None,
    forecast: DataFrame | None = None,
) -> DataFrame:
    """Distinct assortment rows of the network with status, cost, price, stock and tier.

    All that depends on the warehouse alone is joined there (`usn_warehouses`), so the
    assortment meets one table of warehouses. The wide assortment rows are shuffled once, by
    usn: copies go there, all joins are on the usn, and the final distinct shares it. A usn has
    few rows, one per warehouse and copy of its sku, so the warehouse is compared inside the
    joins; and as a usn's rows lie together, its texts shrink in the shuffles. Items, which
    the system rows know, are joined to these by item first. ``active_only`` and the lists are
    as in the material network; ``forecast`` has one row per (location, item), and the rows carry
    it for the forecast attach.
    """
    t = tables
    parts = _place_parts(t["assortment"])

    def placed(df: DataFrame) -> DataFrame:
        return _placed(df.where("usn is not null"), ["usn"], parts)

    warehouses = usn_warehouses(t, params, net)
    if active_only:
        warehouses = warehouses.filter(usn_kept(net))
    # a few rows per warehouse, always small enough to broadcast
    warehouses = F.broadcast(stage(warehouses, "usn-warehouses"))
    here = F.broadcast(warehouses.select("warehouse_number").distinct())
    ids = F.broadcast(warehouses.select(F.col("warehouse_id").alias("shipping_warehouse_id")).distinct())
    located = F.broadcast(warehouses.select(F.col("location").alias("loc")).distinct())
    assortment = placed(
        t["assortment"].select("warehouse_number", "usn", "item_description", "ipr_category")
    ).distinct()
    skus = (
        t["sku"]
        .join(t["taxonomy"].select("taxonomy_id"), "taxonomy_id", "left_semi")
        .select("usn", "sku_id")
    )
    inventory = t["inventory_master"].select("usn", "warehouse_number").join(here, "warehouse_number", "left_semi")
    rows = _at_usn(assortment.join(warehouses, "warehouse_number"), placed(inventory), "left_semi", "warehouse_number")
    rows = _at_usn(rows, placed(skus), "inner")
    if active_only:
        rows = rows.filter(usn_active())

    receipts = (
        t["usn_receipts"]
        .select("usn", F.col("warehouse_num").alias("warehouse_number"), F.col("first_receive_date").alias("receipt_date"))
        .join(here, "warehouse_number", "left_semi")
    )
    prices = dims.unit_price_ratio(
        t["sales"].join(ids, "shipping_warehouse_id", "left_semi"), t["sku"], params.as_of, params.sales_price_days
    ).select("usn", F.col("shipping_warehouse_id").alias("warehouse_id"), "unit_price")
    stock = dims.instock_8w(
        t["instock_weekly"], t["calendar"], net.network, "sku_id", params.as_of, params.snapshot_weeks
    ).drop("instock_rate")
    extract = t["extract"].where("item is not null").join(located, "loc", "left_semi")
    items = dims.item_location(extract, t["item_master"], t["supersession"], net.item_overrides).select(
        "usn",
        F.col("loc").alias("location"),
        "item",
        F.col("category").alias("mcat"),
        "uom",
        F.col("altitem").isNotNull().alias("has_alternate"),
        "udc_pir_cost",
        "udc_velocity_code",
    )
    if item_list is not None:
        items = items.join(item_list, "item", "left")
    rows = _at_usn(rows, placed(receipts), "left", "warehouse_number")
    rows = _at_usn(rows, placed(prices), "left", "warehouse_id")
    rows = _at_usn(rows, placed(stock.join(skus.distinct(), "sku_id")), "left", "sku_id", "warehouse_number")
    rows = _at_usn(rows, placed(items), "left", "location")
    usns = dims.item_usns(t["item_master"], net.item_overrides)
    if place_list is not None:
        orders = place_list.withColumnRenamed("dc", "warehouse_number").join(here, "warehouse_number", "left_semi")
        rows = _at_usn(rows, placed(orders.join(usns, "item")), "left", "item", "warehouse_number")
    if forecast is not None:
        sums = forecast.select("item", "location", F.struct("total_forecasted_qty").alias(policy.CARRIED_FORECAST))
        rows = _at_usn(rows, placed(sums.join(usns, "item")), "left", "item", "location")
    carried = [c for c in (*policy.CARRIED_LISTS, policy.CARRIED_FORECAST) if c in rows.columns]
    no_text = F.lit(None).cast("string")
    rows = rows.withColumns(
        {
            "network": F.lit(net.network),
            "dc": F.col("warehouse_number"),
            "sku": F.col("usn"),
            "material_id": no_text,
            "material_number": no_text,
            "sku_description": F.col("item_description"),
            "superseded_sku": F.when(F.col("has_alternate"), "superseded").otherwise("not superseded"),
            "sku_status": _status(params, net),
            "retail_price": F.col("unit_price"),
            "cogs": F.coalesce("udc_pir_cost", F.lit(0.0)),
            "instock_rate": div0null("instock_numerator", "instock_denominator"),
            "system_velocity": F.col("udc_velocity_code"),
            "proposed_velocity": default_tier(
                "receipt_date", net.status_mode, params.as_of, params.recent_weeks
            ),
            "is_vmi": is_vmi(net.vendor_managed_regions),
            "is_active": is_active(usn_active()),
            "is_filtered_out": is_filtered_out(usn_kept(net)),
            "first_receipt_flg": first_receipt_flag("receipt_date"),
        }
    ).select(*UNIVERSE_COLUMNS, *carried)
    return rows if active_only else rows.distinct()


def _at_usn(rows: DataFrame, lookup: DataFrame, how: str, *same: str) -> DataFrame:
    """Join by the usn, by which both sides lie, and by the columns ``same``.

    These are compared by two inequalities each, for an equality would become part of the placing.
    """
    right = lookup.withColumnsRenamed({c: f"r_{c}" for c in ("usn", *same)})
    on = F.col("usn") == F.col("r_usn")
    for c in same:
        on = on & (F.col(c) <= F.col(f"r_{c}")) & (F.col(c) >= F.col(f"r_{c}"))
    return rows.join(right, on, how).drop(*[f"r_{c}" for c in ("usn", *same)])


# ---- lookups that no result column comes from ------------------------------------------------


def with_material_lookups(
    catalogue: DataFrame, tables: Mapping[str, DataFrame], net: NetworkPolicy
) -> DataFrame:
    """Catalogue rows with the optional lookups of the material network.

    No result column comes from them, so the tiering leaves them out. Codes of
    one digit are padded to two for the category lookup, and category ids lose
    their network prefix by characters, as the tables' keys are built.
    """
    t, code = tables, net.network
    padded = F.when(F.length("mcat_key") <= 1, F.lpad("mcat_key", 2, "0")).otherwise(
        F.col("mcat_key")
    )
    rows = catalogue.withColumns(
        {
            "dc": F.col("werks"),
            "item": zero_trim("matnr"),
            "vendor": zero_trim("lifnr"),
            "category_id": F.concat(F.lit(f"{code}|"), padded),
        }
    )
    hierarchy = t["location_hierarchy"].filter(
        (F.col("business_id") == code) & (F.col("werks") != F.col("svcg_linehaul"))
    )
    alignment = dims.category_alignment(t["category_ref"], code).select(
        F.concat(
            F.ltrim("mcat_id", F.lit(f"{code}|0")), F.ltrim("pcat_id", F.lit(f"{code}|"))
        ).alias("prodcat_key"),
        "merchant",
    )
    known = t["category_xref"].select(
        F.col("mcat_id").alias("category_id"), F.col("mcat_id").alias("known_category")
    )
    feeders = hierarchy.select(F.col("werks").alias("dc"), F.col("svcg_linehaul").alias("linehaul"))
    # keys of few values: a vendor, category or dc may hold a great share of the catalogue
    rows = few_valued_join(rows, known, ("category_id",))
    rows = few_valued_join(rows, dims.vendor_team(t["vendor_team"]), ("vendor",))
    rows = few_valued_join(rows, alignment, ("prodcat_key",))
    rows = few_valued_join(rows, feeders, ("dc",))
    # then one group of lookups per key set, so that each set is one shuffle of the rows
    stock = t["atp"].select(F.col("werks").alias("dc"), "matnr", "atp_qty")
    units = t["instock_view"].select(
        F.col("werks").alias("dc"), zero_trim("matnr").alias("item"), "instock_units"
    )
    plans = t["catalogue_plan"].select("dc", F.col("material").alias("item"), "plan_code")
    far_stock = t["atp"].select(
        F.col("werks").alias("linehaul"), "matnr", F.col("atp_qty").alias("linehaul_atp_qty")
    )
    far_vendor = t["atlas"].select(
        F.col("plant").alias("linehaul"),
        zero_trim("material").alias("item"),
        F.col("vendor").alias("linehaul_vendor"),
    )
    rows = lookup_join(rows, [stock], ("dc", "matnr"))
    rows = lookup_join(rows, [units, plans], ("dc", "item"))
    rows = lookup_join(rows, [far_stock], ("linehaul", "matnr"))
    rows = lookup_join(rows, [far_vendor], ("linehaul", "item"))
    return rows.select(
        "dc",
        "item",
        "known_category",
        "inventory_analyst",
        "manager",
        "atp_qty",
        "linehaul",
        "linehaul_atp_qty",
        "instock_units",
        "plan_code",
        "linehaul_vendor",
        "merchant",
    )


def with_usn_lookups(
    assortment: DataFrame,
    tables: Mapping[str, DataFrame],
    net: NetworkPolicy,
    category_prefix: str = "PRO",
) -> DataFrame:
    """Assortment rows with the optional lookups of the usn network, also left out there."""
    t = tables
    routes = dims.linehaul(t["supplier_items"], t["warehouse_lookup"]).select(
        "usn", F.col("destination_plant").alias("warehouse_number"), "source_plant"
    )
    sources = t["assortment"].select(
        "usn",
        F.col("warehouse_number").alias("source_plant"),
        F.col("ipr_category").alias("source_category"),
    )
    taxonomy = t["taxonomy"].select(
        "taxonomy_id",
        F.concat(F.lit(f"{category_prefix}|"), F.col("taxonomy_level_1_id").cast("string")).alias(
            "category_id"
        ),
        F.trim(F.upper("taxonomy_level_2_id")).alias("level2"),
    )
    merchants = t["category_ref"].filter(
        (F.col("source") == net.network) & F.col("is_current")
    ).select(F.trim(F.upper("material_level2_code")).alias("level2"), "dmm").distinct()
    known = t["category_xref"].select(
        F.col("mcat_id").alias("category_id"), F.col("mcat_id").alias("known_category")
    )
    kinds = t["storage_type"].select("usn", F.col("warehouse_num").alias("warehouse_number"), "storage_type")
    # what hangs on a sku alone is looked up once per sku, not once per assortment row
    goods = t["sku"].select("usn", "sku_id", "taxonomy_id")
    goods = few_valued_join(goods, taxonomy.withColumn("has_taxonomy", F.lit(True)), ("taxonomy_id",))
    goods = goods.where("has_taxonomy")
    goods = few_valued_join(goods, known, ("category_id",))
    goods = few_valued_join(goods, merchants, ("level2",)).select("usn", "sku_id", "known_category", "dmm")
    rows = lookup_join(assortment, [kinds, routes], ("usn", "warehouse_number"))
    rows = lookup_join(rows, [sources], ("usn", "source_plant"))
    return rows.join(goods, "usn").select(
        "usn",
        "warehouse_number",
        "sku_id",
        "storage_type",
        "source_plant",
        "source_category",
        "known_category",
        "dmm",
    )
