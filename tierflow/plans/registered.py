"""Registered queries: every operator on the tables of a test folder, with its checking SQL.

Whole runs are written once per session and folder as derived tables, as a
production run would write its analysis table; the audit and impact queries
start from these tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.functions import div0null
from tierflow.operators import audit, classify, dims, impact, output, stock, universe
from tierflow.plans import driver_tables, policy, runs
from tierflow.plans.driver_tables import (
    AS_OF,
    MATERIAL,
    MATERIAL_BEFORE,
    PARAMS,
    USN,
    material_tables,
    usn_tables,
)
from tierflow.plans.oracle import now_counts, stock_pivot, tier_pivot, with_expressions
from tierflow.sources import registry, sinks, uploads

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_expressions(sql)
        return fn

    return keep


# ---- derived tables -----------------------------------------------------------------------------

def _derived(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame, written on first use of this session and folder and read from then on."""
    return registry.written_once(spark, f"{sf_dir}/{name}", name, build)


_RUNS = {
    "before": (material_tables, MATERIAL_BEFORE, "material"),
    "after": (material_tables, MATERIAL, "material"),
    "usn": (usn_tables, USN, "usn"),
}


def dated_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rows of the material network with all receipt dates: both its runs start from them."""
    return _derived(
        spark,
        sf_dir,
        "dated-universe",
        lambda: runs.dated_universe(material_tables(spark, sf_dir), PARAMS, MATERIAL),
    )


def run_of(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Whole run from the source tables."""
    tables, net, kind = _RUNS[which]
    dated = dated_of(spark, sf_dir) if kind == "material" else None
    return runs.reclassify(tables(spark, sf_dir), PARAMS, net, kind, dated)


def analysis_of(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return _derived(spark, sf_dir, f"analysis-{which}", lambda: run_of(spark, sf_dir, which))


def base_of(spark: SparkSession, sf_dir: str, which: str, lists: bool = False) -> DataFrame:
    """Active rows of a run; with ``lists``, those of the material network keep the stock operators' lists."""
    tables, net, kind = _RUNS[which]
    if kind == "material":
        rows = universe.with_receipts(dated_of(spark, sf_dir), PARAMS, net)
        return rows if lists else rows.drop(*policy.CARRIED_LISTS)

    def build() -> DataFrame:
        return runs.active_universe(tables(spark, sf_dir), PARAMS, net, kind)

    return _derived(spark, sf_dir, f"base-{which}", build)


def upload_of(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Change rows of a run as an upload."""
    return uploads.as_upload(
        output.upload_rows(output.changes(analysis_of(spark, sf_dir, which), AS_OF))
    )


def cohort_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        before, after = analysis_of(spark, sf_dir, "before"), analysis_of(spark, sf_dir, "after")
        return impact.cohort_of(*impact.reported(before, after))

    return _derived(spark, sf_dir, "impact-cohort", build)


def moved_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.transitioned(cohort_of(spark, sf_dir))


def detail_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.transition_detail(moved_of(spark, sf_dir))


def status_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = audit.latest_state(uploads.as_state(material_tables(spark, sf_dir)["state_report"]))
    return audit.apply_status(upload_of(spark, sf_dir, "after"), state)


# ---- dimensions -------------------------------------------------------------------------------


@register("calendar_info", "select * from o_calendar_info")
def _(spark, sf_dir):
    return dims.calendar_info(material_tables(spark, sf_dir)["calendar"], AS_OF)


@register("vendor_team", "select * from o_vendor_team")
def _(spark, sf_dir):
    return dims.vendor_team(material_tables(spark, sf_dir)["vendor_team"])


@register("unit_price_avg", "select * from o_unit_price_avg")
def _(spark, sf_dir):
    t = material_tables(spark, sf_dir)
    df = dims.unit_price_avg(
        t["order_lines"], t["order_headers"], t["catalogue"], t["plant_ext"], "N1", AS_OF
    )
    return df


@register("unit_price_ratio", "select * from o_unit_price_ratio")
def _(spark, sf_dir):
    t = usn_tables(spark, sf_dir)
    return dims.unit_price_ratio(t["sales"], t["sku"], AS_OF)


@register("category_alignment", "select * from o_category_alignment")
def _(spark, sf_dir):
    return dims.category_alignment(material_tables(spark, sf_dir)["category_ref"], "N1")


@register("location_map", "select * from o_customer_locations")
def _(spark, sf_dir):
    return dims.location_map(material_tables(spark, sf_dir)["customer_locations"])


@register("item_location", "select * from o_item_location")
def _(spark, sf_dir):
    t = usn_tables(spark, sf_dir)
    return dims.item_location(t["extract"], t["item_master"], t["supersession"])


@register("instock_by_item", "select * from o_instock")
def _(spark, sf_dir):
    t = material_tables(spark, sf_dir)
    df = dims.instock_8w(t["instock_weekly"], t["calendar"], "N1", "item", AS_OF)
    return df


@register("instock_by_sku", "select * from o_instock_usn")
def _(spark, sf_dir):
    t = usn_tables(spark, sf_dir)
    df = dims.instock_8w(t["instock_weekly"], t["calendar"], "N2", "sku_id", AS_OF)
    return df


@register("forecast_window", "select * from o_forecast")
def _(spark, sf_dir):
    t = material_tables(spark, sf_dir)
    return dims.forecast_window(t["forecast"], t["plant"], "N1", AS_OF)


@register("forecast_window_usn", "select * from o_forecast_usn")
def _(spark, sf_dir):
    t = usn_tables(spark, sf_dir)
    return dims.forecast_window(t["forecast"], t["plant"], "N2", AS_OF)


@register("soq_first_weeks", "select * from o_soq")
def _(spark, sf_dir):
    return dims.soq_first_weeks(material_tables(spark, sf_dir)["soq"], PARAMS.fiscal_year)


@register("high_cube", "select * from o_high_cube")
def _(spark, sf_dir):
    return dims.high_cube(
        material_tables(spark, sf_dir)["item_master"], MATERIAL.high_cube_categories
    )


@register("import_flag", "select * from o_import_flag")
def _(spark, sf_dir):
    return dims.import_flag(material_tables(spark, sf_dir)["item_master"])


@register("receipt_xref", "select * from o_receipt_xref")
def _(spark, sf_dir):
    t = material_tables(spark, sf_dir)
    return dims.receipt_xref(t["usn_receipts"], t["item_xref"], t["plant"], t["warehouse_moves"])


@register("linehaul", "select * from o_linehaul")
def _(spark, sf_dir):
    t = usn_tables(spark, sf_dir)
    return dims.linehaul(t["supplier_items"], t["warehouse_lookup"])


@register("warehouse_crosswalk", "select * from o_supplier_crosswalk")
def _(spark, sf_dir):
    return dims.warehouse_crosswalk(usn_tables(spark, sf_dir)["supplier_names"])


@register(
    "duplicate_locations",
    """select dc, count(*) as rows from o_customer_locations where dc is not null
       group by dc having count(*) > 1""",
)
def _(spark, sf_dir):
    locations = dims.location_map(material_tables(spark, sf_dir)["customer_locations"])
    return dims.duplicate_keys(locations, "dc")


# ---- universe and flags -------------------------------------------------------------------------



def _universe_query(which: str, build):
    tables, net, _ = _RUNS[which]

    def query(spark, sf_dir):
        return build(tables(spark, sf_dir), PARAMS, net)

    return query


register("universe_material_no_receipt", "select * from o_universe_before")(
    _universe_query("before", universe.universe_material)
)
register("universe_material", "select * from o_universe_after")(
    _universe_query("after", universe.universe_material)
)
register("universe_usn", "select * from o_universe_usn")(
    _universe_query("usn", universe.universe_usn)
)


@register("material_lookups", "select * from o_material_lookups")
def _(spark, sf_dir):
    t = material_tables(spark, sf_dir)
    return universe.with_material_lookups(t["catalogue"], t, MATERIAL)


@register("usn_lookups", "select * from o_usn_lookups")
def _(spark, sf_dir):
    t = usn_tables(spark, sf_dir)
    return universe.with_usn_lookups(t["assortment"], t, USN)


def _dated_pairs(spark, sf_dir) -> DataFrame:
    """All (dc, item) with their own and cross-network receipt dates."""
    t = material_tables(spark, sf_dir)
    own = t["receipts"].select("dc", "item", F.col("first_date").alias("own_date"))
    cross = dims.receipt_xref(
        t["usn_receipts"], t["item_xref"], t["plant"], t["warehouse_moves"]
    ).select(
        F.col("plant_id").alias("dc"),
        F.ltrim("material_number", F.lit("0")).alias("item"),
        "cross_receipt_date",
    )
    return (
        t["pairs"].select("dc", "item")
        .join(own, ["dc", "item"], "left")
        .join(cross, ["dc", "item"], "left")
    )


_DATED_SQL = """(select q.dc, q.item, r.first_date as own_date, x.cross_receipt_date
    from pairs q left join receipts r on q.dc = r.dc and q.item = r.item
    left join o_receipt_xref x on q.dc = x.plant_id and q.item = ltrim(x.material_number, '0'))"""

_NEW_SQL = {
    "no_receipt": "own_date is null",
    "coalesced": "coalesce(own_date, cross_receipt_date) is null",
    "recent": f"(own_date is null or own_date >= date '{AS_OF}' - 91)",
}


def _status_query(mode: str):
    def query(spark, sf_dir):
        date = universe.receipt_date(mode, "own_date", "cross_receipt_date")
        return (
            _dated_pairs(spark, sf_dir)
            .withColumn("receipt_date", date)
            .select(
                "dc",
                "item",
                "receipt_date",
                universe.sku_status("receipt_date", mode, AS_OF).alias("sku_status"),
            )
        )

    return query


for _mode, _new in _NEW_SQL.items():
    _date = "coalesce(own_date, cross_receipt_date)" if _mode == "coalesced" else "own_date"
    register(
        f"sku_status_{_mode}",
        f"""select dc, item, {_date} as receipt_date,
            case when {_new} then 'New' else 'Not New' end as sku_status from {_DATED_SQL}""",
    )(_status_query(_mode))


@register(
    "first_receipt_flag",
    f"""select dc, item, case when own_date is null then 'No First Receipt' else 'First Receipt'
        end as first_receipt_flg from {_DATED_SQL}""",
)
def _(spark, sf_dir):
    return _dated_pairs(spark, sf_dir).select(
        "dc", "item", universe.first_receipt_flag("own_date").alias("first_receipt_flg")
    )


@register(
    "default_tier",
    f"""select dc, item, case when {_NEW_SQL['recent']} then 'C' else 'E' end as proposed_velocity
        from {_DATED_SQL}""",
)
def _(spark, sf_dir):
    return _dated_pairs(spark, sf_dir).select(
        "dc", "item", universe.default_tier("own_date", "recent", AS_OF).alias("proposed_velocity")
    )


@register(
    "superseded_flag",
    """select x.item, x.loc, case when s.altitem is not null then 'superseded'
       else 'not superseded' end as superseded_sku
       from extract x left join supersession s on x.item = s.item""",
)
def _(spark, sf_dir):
    t = material_tables(spark, sf_dir)
    return (
        t["extract"]
        .join(t["supersession"], "item", "left")
        .select("item", "loc", universe.superseded_flag("altitem").alias("superseded_sku"))
    )


@register(
    "material_flags",
    "select dc, item, is_active, is_filtered_out, is_vmi from o_universe_before",
)
def _(spark, sf_dir):
    catalogue = material_tables(spark, sf_dir)["catalogue"]
    return catalogue.select(
        F.col("werks").alias("dc"),
        F.ltrim("matnr", F.lit("0")).alias("item"),
        universe.is_active(universe.material_active()).alias("is_active"),
        universe.is_filtered_out(universe.material_kept(MATERIAL)).alias("is_filtered_out"),
        universe.is_vmi().alias("is_vmi"),
    )


@register(
    "usn_flags",
    """select a.warehouse_number, a.usn,
        coalesce(s.sku_id <> 0 and upper(a.ipr_category) = 'REPLENISHED', false) as is_active,
        coalesce(not (a.warehouse_number not in ('3') and w.is_open_for_operations = 1), true)
            as is_filtered_out,
        coalesce(r.r_name in ('ASIA'), false) as is_vmi
       from assortment a join sku s on a.usn = s.usn
       join nation n on a.warehouse_number = cast(n.n_nationkey as varchar)
       join region r on n.n_regionkey = r.r_regionkey
       join warehouse w on w.warehouse_id = n.n_nationkey""",
)
def _(spark, sf_dir):
    t = usn_tables(spark, sf_dir)
    places = t["open_warehouse"].select(
        "warehouse_id", F.col("warehouse_num").alias("warehouse_number"), "region_name"
    ).join(t["warehouse"], "warehouse_id")
    return (
        t["assortment"]
        .join(t["sku"], "usn")
        .join(places, "warehouse_number")
        .select(
            "warehouse_number",
            "usn",
            universe.is_active(universe.usn_active()).alias("is_active"),
            universe.is_filtered_out(universe.usn_kept(USN)).alias("is_filtered_out"),
            universe.is_vmi(USN.vendor_managed_regions).alias("is_vmi"),
        )
    )


@register(
    "instock_rate",
    """select dc, item, case when den is null or den = 0 then 0 else num / den end as instock_rate
       from (select q.dc, q.item, sum(case when w.l_linestatus = 'O'
                and w.l_returnflag <> 'R' then w.qty end) as num,
                sum(case when w.l_linestatus = 'O' then w.qty end) as den
             from pairs q join shipments w on q.dc = w.dc and q.item = w.item group by all)""",
)
def _(spark, sf_dir):
    shipments = material_tables(spark, sf_dir)["shipments"]
    open_qty = F.when(F.col("l_linestatus") == "O", F.col("qty"))
    sums = shipments.groupBy("dc", "item").agg(
        F.sum(F.when(F.col("l_returnflag") != "R", open_qty)).alias("num"),
        F.sum(open_qty).alias("den"),
    )
    return sums.select(
        "dc", "item", div0null("num", "den").alias("instock_rate")
    )


# ---- tiering ------------------------------------------------------------------------------------



@register("attach_forecast", "select * from o_base_after")
def _(spark, sf_dir):
    t = material_tables(spark, sf_dir)
    return runs.active_universe(t, PARAMS, MATERIAL, "material")


@register("attach_forecast_usn", "select * from o_base_usn")
def _(spark, sf_dir):
    t = usn_tables(spark, sf_dir)
    return runs.active_universe(t, PARAMS, USN, "usn")


@register("weekly_metrics", "select * from o_weekly_after")
def _(spark, sf_dir):
    return classify.weekly_metrics(base_of(spark, sf_dir, "after"))


@register("velocity_weight", "select * from o_weight_after")
def _(spark, sf_dir):
    rows = base_of(spark, sf_dir, "after").filter(classify.is_ranked())
    weighted = classify.velocity_weight(classify.weekly_metrics(rows))
    return weighted


@register(
    "is_ranked",
    """select dc, item, is_forecasted = 'Forecasted' and (sku_status <> 'New'
        or superseded_sku = 'superseded') as is_ranked from o_base_after""",
)
def _(spark, sf_dir):
    return base_of(spark, sf_dir, "after").select(
        "dc", "item", classify.is_ranked().alias("is_ranked")
    )


@register(
    "tier_percentile",
    """select dc, mcat, item, velocity_weight,
        calculated_velocity_percentile from o_percentile_after""",
)
def _(spark, sf_dir):
    rows = base_of(spark, sf_dir, "after").filter(classify.is_ranked())
    ranked = classify.tier_percentile(classify.velocity_weight(rows))
    return ranked.select(
        "dc",
        "mcat",
        "item",
        "velocity_weight",
        "calculated_velocity_percentile",
    )


@register(
    "shipment_percentile",
    """select l_returnflag, l_linestatus, l_orderkey, l_linenumber, qty,
        round(percent_rank() over (partition by l_returnflag, l_linestatus order by qty desc), 3)
            as calculated_velocity_percentile from shipments""",
)
def _(spark, sf_dir):
    """Ranking of few, large groups with many equal weights."""
    rows = material_tables(spark, sf_dir)["shipments"].select(
        "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "qty"
    )
    return classify.tier_percentile(rows, ("l_returnflag", "l_linestatus"), "qty")


@register("ranked_tiers", "select * from o_ranked_after")
def _(spark, sf_dir):
    ranked = classify.ranked_tiers(base_of(spark, sf_dir, "after"), PARAMS)
    return ranked


@register("forced_c", "select * from o_forced_after")
def _(spark, sf_dir):
    return classify.forced_c(base_of(spark, sf_dir, "after"), PARAMS)


@register("unforecast_tier", "select * from o_unforecast_after")
def _(spark, sf_dir):
    return classify.unforecast_tier(base_of(spark, sf_dir, "after"), PARAMS)


@register("classify", "select * from o_classified_after")
def _(spark, sf_dir):
    tiers = classify.classify(base_of(spark, sf_dir, "after"), PARAMS)
    return tiers


def _covered(spark, sf_dir) -> DataFrame:
    """Rows with their coverage; they carry their flags and orders, as in a whole run."""
    tiers = classify.classify(base_of(spark, sf_dir, "after", lists=True), PARAMS)
    items = material_tables(spark, sf_dir)["item_master"]
    return stock.sscov(tiers, items, MATERIAL.high_cube_categories)


@register("coverage_weeks", "select * from o_sscov_after")
def _(spark, sf_dir):
    return _covered(spark, sf_dir).drop(policy.ORDER_LIST)


@register("safety_stock", "select * from o_stock_after")
def _(spark, sf_dir):
    t = material_tables(spark, sf_dir)
    orders = dims.soq_first_weeks(t["soq"], PARAMS.fiscal_year)
    return stock.safety_stock(_covered(spark, sf_dir), t["plant"], orders)


@register(
    "change_class",
    """select item, loc, case when udc_velocity_code is null or other is null then 'Unclassified'
        when udc_velocity_code = other then 'Match'
        when udc_velocity_code < other then 'Demotion' else 'Promotion' end
        as velocity_change_class
       from (select x.item, x.loc, x.udc_velocity_code,
                case s.sku_status when 'New' then 'C' when 'Not New' then 'E' end as other
             from extract x left join o_universe_before s on x.item = s.item and x.loc = s.dc)""",
)
def _(spark, sf_dir):
    t = material_tables(spark, sf_dir)
    proposed = (
        t["pairs"]
        .join(t["receipts"].select("dc", "item", "first_date"), ["dc", "item"], "left")
        .select(
            F.col("dc").alias("loc"),
            "item",
            universe.default_tier("first_date", "no_receipt", AS_OF).alias("other"),
        )
    )
    return (
        t["extract"]
        .join(proposed, ["item", "loc"], "left")
        .select(
            "item",
            "loc",
            stock.change_class("udc_velocity_code", "other").alias("velocity_change_class"),
        )
    )


@register(
    "service_level",
    f"""select item, loc, cast(case udc_velocity_code
        {' '.join(f"when '{t}' then {v}" for t, v in policy.SERVICE_LEVELS.items())}
        else 99999 end as double) as service_level from extract""",
)
def _(spark, sf_dir):
    extract = material_tables(spark, sf_dir)["extract"]
    return extract.select(
        "item", "loc", output.service_level("udc_velocity_code").alias("service_level")
    )


@register(
    "velocity_reason",
    "select dc, jda_item, velocity_reason from o_analysis_after",
)
def _(spark, sf_dir):
    return base_of(spark, sf_dir, "after").select(
        "dc", F.col("item").alias("jda_item"), output.velocity_reason().alias("velocity_reason")
    )




def _analysis_query(which: str):
    def query(spark, sf_dir):
        return run_of(spark, sf_dir, which)

    return query


for _which, _name in {
    "before": "analysis_material_no_receipt",
    "after": "analysis_material",
    "usn": "analysis_usn",
}.items():
    register(_name, f"select * from o_analysis_{_which}")(_analysis_query(_which))


@register("changes_material", "select * from o_changes_after")
def _(spark, sf_dir):
    return output.changes(analysis_of(spark, sf_dir, "after"), AS_OF)


@register("changes_usn", "select * from o_changes_usn")
def _(spark, sf_dir):
    return output.changes(analysis_of(spark, sf_dir, "usn"), AS_OF)


@register("upload_rows", "select * from o_upload_after")
def _(spark, sf_dir):
    return output.upload_rows(output.changes(analysis_of(spark, sf_dir, "after"), AS_OF))


# ---- sources and sinks, each written and read back ------------------------------------------------


@register("table_registry", "select n_nationkey, n_name, n_regionkey as region from nation")
def _(spark, sf_dir):
    named = registry.tables(
        spark,
        {"places": {"path": f"{sf_dir}/nation.parquet", "rename": {"n_regionkey": "region"}}},
    )
    return named["places"]


_UPLOAD_SQL = """select jda_item as "JDA_ITEM", jda_loc as "JDA_LOC",
    proposed_velocity as "PROPOSED_VELOCITY", proposed_velocity_ as "PROPOSED_VELOCITY_",
    cast(service_level as varchar) as "SERVICE_LEVEL", sap_velocity as "SAP_VELOCITY",
    velocity_reason as "VELOCITY_REASON" from o_upload_after"""


@register("upload_round_trip", _UPLOAD_SQL)
def _(spark, sf_dir):
    path = registry.scratch_path(spark, "upload")
    rows = output.upload_rows(output.changes(analysis_of(spark, sf_dir, "after"), AS_OF))
    sinks.write_delta(rows, path)
    return uploads.read_upload(spark, path)


@register("segmented_round_trip", _UPLOAD_SQL)
def _(spark, sf_dir):
    path = registry.scratch_path(spark, "upload-by-tier")
    rows = output.upload_rows(output.changes(analysis_of(spark, sf_dir, "after"), AS_OF))
    sinks.write_by_tier(rows, path)
    return uploads.read_by_tier(spark, path)


@register("delta_reload", "select * from o_template")
def _(spark, sf_dir):
    directory = registry.scratch_path(spark, "audit-report")
    sinks.write_report({"not_updated": audit.not_updated(status_of(spark, sf_dir))}, directory)
    return uploads.upload_from_delta(uploads.read_sheet(spark, directory, "not_updated"))


@register(
    "state_sheet",
    """select "ITEM", "DC NUMBER", "VELOCITY", "ITEM DESCRIPTION", "MCAT", "PCAT",
        cast(seq as varchar) as seq from state_report""",
)
def _(spark, sf_dir):
    directory = registry.scratch_path(spark, "state-report")
    report = material_tables(spark, sf_dir)["state_report"]
    sinks.write_report({policy.STATE_SHEET: report}, directory)
    return uploads.read_state(spark, directory)


@register(
    "output_preview",
    """select count(*) as rows, max(table_created_date) as last_created_date,
        count_if(table_created_date is distinct from date '2000-01-03') as rows_of_other_days
       from o_analysis_after""",
)
def _(spark, sf_dir):
    return sinks.preview(analysis_of(spark, sf_dir, "after"), AS_OF)


@register(
    "input_profile",
    """select count(*) as rows, 5 as columns,
        'item,loc,udc_purch_uom,udc_velocity_code,udc_pir_cost' as column_names from extract""",
)
def _(spark, sf_dir):
    return registry.profile(material_tables(spark, sf_dir)["extract"]).drop("first_rows")


@register(
    "input_head",
    """select row_number() over ()::int as place, p_partkey, p_name, p_retailprice,
        (select count(*) from part) as rows from (from part limit 5)""",
)
def _(spark, sf_dir):
    """First rows of an input beside its size, in one pass."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_retailprice")
    seen = registry.profile(part).select("rows", F.posexplode("first_rows").alias("at", "row"))
    return seen.select((F.col("at") + 1).alias("place"), "row.*", "rows")


@register(
    "quoted_round_trip",
    """select jda_item as "JDA_ITEM", jda_loc as "JDA_LOC", new_proposed_velocity as "PROPOSED_VELOCITY",
        'line' || chr(10) || '"two", ' || sku_description || chr(13) || chr(10) || 'C:\\x ' as "NOTE"
       from o_analysis_after""",
)
def _(spark, sf_dir):
    """Texts with line breaks, quotes, commas and blanks, written as CSV and read back."""
    path = registry.scratch_path(spark, "notes")
    note = F.concat(F.lit('line\n"two", '), "sku_description", F.lit("\r\nC:\\x "))
    rows = analysis_of(spark, sf_dir, "after").select(
        F.col("jda_item").alias("JDA_ITEM"),
        F.col("jda_loc").alias("JDA_LOC"),
        F.col("new_proposed_velocity").alias("PROPOSED_VELOCITY"),
        note.alias("NOTE"),
    )
    sinks.write_delta(rows, path)
    return uploads.read_upload(spark, path).select("JDA_ITEM", "JDA_LOC", "PROPOSED_VELOCITY", "NOTE")


@register("no_tier_round_trip", f"select * from ({_UPLOAD_SQL}) where false")
def _(spark, sf_dir):
    """A tier export without any row of the five tiers, read back."""
    path = registry.scratch_path(spark, "no-tiers")
    rows = output.upload_rows(output.changes(analysis_of(spark, sf_dir, "after"), AS_OF))
    sinks.write_by_tier(rows.withColumn("proposed_velocity", F.lit(policy.MISSING_TIER)), path)
    return uploads.read_by_tier(spark, path)


@register(
    "table_overwrite",
    """select jda_item, jda_loc, new_proposed_velocity, 2 as version from o_analysis_after
       where new_proposed_velocity <> system_velocity""",
)
def _(spark, sf_dir):
    """A table replaced twice, the second time by rows read from itself."""
    path = registry.scratch_path(spark, "derived-table")
    rows = analysis_of(spark, sf_dir, "after").select("jda_item", "jda_loc", "new_proposed_velocity", "system_velocity")
    sinks.write_table(rows, "", path)
    changed = spark.read.parquet(path).where("new_proposed_velocity <> system_velocity")
    sinks.write_table(changed.withColumn("version", F.lit(1)), "", path)
    again = spark.read.parquet(path).withColumn("version", F.col("version") + 1)
    sinks.write_table(again, "", path)
    return spark.read.parquet(path).drop("system_velocity")


# ---- audit --------------------------------------------------------------------------------------


def _validated(spark, sf_dir) -> DataFrame:
    rows = analysis_of(spark, sf_dir, "usn")
    upload = output.upload_rows(output.changes(rows, AS_OF)).select(
        F.col("jda_item").alias("JDA_ITEM"),
        F.col("jda_loc").alias("JDA_LOC"),
        F.col("proposed_velocity").alias("PROPOSED_VELOCITY"),
        F.col("dc").alias("DC"),
        F.col("usn").alias("USN"),
    )
    return audit.validate(upload, usn_tables(spark, sf_dir)["extract"])


@register("validate", "select * from o_validated")
def _(spark, sf_dir):
    return _validated(spark, sf_dir)


@register(
    "validation_summary",
    """select 'Total Records' as statistic, count(*) as count from o_validated
       union all select 'Matches', count_if("Match") from o_validated
       union all select 'Mismatches', count_if(not "Match") from o_validated""",
)
def _(spark, sf_dir):
    return audit.validation_summary(_validated(spark, sf_dir))


@register("diff_uploads", "select * from o_diff")
def _(spark, sf_dir):
    return audit.diff_uploads(upload_of(spark, sf_dir, "before"), upload_of(spark, sf_dir, "after"))


@register(
    "diff_summary",
    """select (select count(*) from o_old_upload) as old_rows,
        (select count(*) from o_new_upload) as new_rows,
        (select count(*) from o_diff) as changed_rows,
        count_if(presence = 'old_only') as only_in_old,
        count_if(presence = 'new_only') as only_in_new,
        count_if(presence = 'both' and proposed_velocity_old <> proposed_velocity_new)
            as different_velocity from o_outer""",
)
def _(spark, sf_dir):
    return audit.diff_summary(upload_of(spark, sf_dir, "before"), upload_of(spark, sf_dir, "after"))


@register(
    "diff_report",
    """select "JDA_ITEM", "JDA_LOC", nullif(proposed_velocity_old, '') as proposed_velocity_old,
        nullif(proposed_velocity_new, '') as proposed_velocity_new, presence
       from o_diff""",
)
def _(spark, sf_dir):
    """The whole diff run: changed rows and counts written as a report, and the rows read back."""
    directory = registry.scratch_path(spark, "diff-report")
    old, new = upload_of(spark, sf_dir, "before"), upload_of(spark, sf_dir, "after")
    sinks.write_report(runs.diff_report(old, new), directory)
    return uploads.read_sheet(spark, directory, "changes")


@register("latest_state", "select * from o_state")
def _(spark, sf_dir):
    return audit.latest_state(uploads.as_state(material_tables(spark, sf_dir)["state_report"]))


@register(
    "apply_status",
    """select "ITEM", "DC NUMBER", proposed_velocity as "PROPOSED_VELOCITY", parm_velocity, status
       from o_status""",
)
def _(spark, sf_dir):
    return status_of(spark, sf_dir).select(
        "ITEM", F.col("`DC NUMBER`"), "PROPOSED_VELOCITY", "parm_velocity", "status"
    )


@register("not_updated", "select * from o_not_updated")
def _(spark, sf_dir):
    return audit.not_updated(status_of(spark, sf_dir))


@register(
    "apply_summary",
    """select count(*) as thursday_rows, count_if(status = 'UPDATED_MATCH') as updated_match_rows,
        count_if(status = 'NOT_UPDATED_MISMATCH') as not_updated_mismatch_rows,
        count_if(status = 'MISSING_IN_PARM') as missing_in_parm_rows,
        count_if(status <> 'UPDATED_MATCH') as not_updated_total_rows,
        round(count_if(status <> 'UPDATED_MATCH') / count(*) * 100.0, 2) as pct_not_updated
       from o_status""",
)
def _(spark, sf_dir):
    return audit.apply_summary(status_of(spark, sf_dir))


def _subset_query(mode: str):
    def query(spark, sf_dir):
        return audit.apply_subset(status_of(spark, sf_dir), mode).select(
            "ITEM", F.col("`DC NUMBER`"), "parm_velocity", "status"
        )

    return query


for _mode, _statuses in audit.SUBSET_MODES.items():
    register(
        f"apply_subset_{_mode}",
        f"""select "ITEM", "DC NUMBER", parm_velocity, status from o_status
            where status in ({', '.join(f"'{s}'" for s in _statuses)})""",
    )(_subset_query(_mode))


@register("upload_template", "select * from o_template")
def _(spark, sf_dir):
    return audit.to_template(audit.apply_subset(status_of(spark, sf_dir)))


@register(
    "segment_counts",
    """select t as segment, (select count(*) from o_template
            where upper(trim("PROPOSED_VELOCITY")) = t) as rows from o_tiers
       union all select 'Total', count(*) from o_template""",
)
def _(spark, sf_dir):
    template = audit.to_template(audit.apply_subset(status_of(spark, sf_dir)))
    return audit.segment_counts(template)


# ---- impact -------------------------------------------------------------------------------------


@register(
    "merge_runs",
    """select coalesce(a.jda_item, b.jda_item) as jda_item,
        coalesce(a.jda_loc, b.jda_loc) as jda_loc, a.sku_status as sku_status_old,
        b.sku_status as sku_status_new, a.new_proposed_velocity as new_proposed_velocity_old,
        b.new_proposed_velocity as new_proposed_velocity_new,
        case when b.jda_item is null then 'old_only' when a.jda_item is null then 'new_only'
             else 'both' end as presence
       from o_analysis_before a full join o_analysis_usn b
        on a.jda_item = b.jda_item and a.jda_loc = cast(cast(b.jda_loc as int) - 3211 as varchar)""",
)
def _(spark, sf_dir):
    """Two runs over different networks, so that keys are missing on either side."""
    columns = ["jda_item", "jda_loc", "sku_status", "new_proposed_velocity"]
    old = analysis_of(spark, sf_dir, "before").select(*columns)
    new = analysis_of(spark, sf_dir, "usn").select(*columns)
    shifted = new.withColumn(
        "jda_loc", (F.col("jda_loc").cast("int") - 3211).cast("string")
    )
    merged = impact.merge_runs(old, shifted)
    # locations of rows of the usn network alone are shown as that network numbers them
    usn_loc = (F.col("jda_loc").cast("int") + 3211).cast("string")
    only_new = F.col("presence") == "new_only"
    return merged.withColumn("jda_loc", F.when(only_new, usn_loc).otherwise(F.col("jda_loc")))


@register("new_forecasted_cohort", "select jda_item, jda_loc, transition from o_cohort")
def _(spark, sf_dir):
    before, after = analysis_of(spark, sf_dir, "before"), analysis_of(spark, sf_dir, "after")
    return impact.cohort_of(before, after).select("jda_item", "jda_loc", "transition")


@register(
    "presence_counts",
    """select case when b.jda_item is null then 'old_only' when a.jda_item is null
        then 'new_only' else 'both' end as presence, count(*) as rows
       from o_analysis_before a full join o_analysis_after b
        on a.jda_item = b.jda_item and a.jda_loc = b.jda_loc group by all""",
)
def _(spark, sf_dir):
    return impact.presence_counts(
        analysis_of(spark, sf_dir, "before"), analysis_of(spark, sf_dir, "after")
    )


@register("bucket_shift", "select * from o_bucket_shift")
def _(spark, sf_dir):
    return impact.bucket_shift(
        analysis_of(spark, sf_dir, "before"), analysis_of(spark, sf_dir, "after")
    )


@register("transition_summary", "select * from o_transitions")
def _(spark, sf_dir):
    return impact.transition_summary(cohort_of(spark, sf_dir))


@register("transition_breakdown", "select * from o_transitions where record_count > 0")
def _(spark, sf_dir):
    return impact.transition_breakdown(cohort_of(spark, sf_dir))


@register("new_tier_dist", "select * from o_new_tier_dist")
def _(spark, sf_dir):
    return impact.new_tier_dist(moved_of(spark, sf_dir))


@register("ss_impact", "select * from o_ss_impact")
def _(spark, sf_dir):
    return impact.ss_impact(moved_of(spark, sf_dir))


@register("tier_dist", "select * from o_tier_dist")
def _(spark, sf_dir):
    return impact.tier_dist(
        analysis_of(spark, sf_dir, "before"), analysis_of(spark, sf_dir, "after")
    )


@register("reason_dist", "select * from o_reason_dist")
def _(spark, sf_dir):
    return impact.reason_dist(
        analysis_of(spark, sf_dir, "before"), analysis_of(spark, sf_dir, "after")
    )


_SUMMARY_SQL = "\nunion all\n".join(
    [
        *[
            f"select 'Universe Overview' as section, '{c}' as metric, "
            f"cast({c} as double) as value, cast(null as double) as detail from o_bucket_shift"
            for c in ("old_rows", "new_rows", "net_rows")
        ],
        *[
            f"select 'New+Forecasted Bucket Shift', '{c}', cast({c} as double), "
            + ("pct_new_forecasted" if c == "net_new_forecasted" else "null")
            + " from o_bucket_shift"
            for c in ("old_new_forecasted", "new_new_forecasted", "net_new_forecasted")
        ],
        "select 'Transition Breakdown', transition, record_count, pct_of_total from o_transitions",
        "select 'Velocity Assignments for Transitioned Records', velocity, record_count, "
        "pct_of_total from o_new_tier_dist",
        *[
            f"select 'Safety Stock Impact', '{c}', {c}, null from o_ss_impact"
            for c in (
                "old_proposed_ss",
                "new_proposed_ss",
                "ss_delta",
                "old_ss_change_dollars",
                "new_ss_change_dollars",
            )
        ],
        "select 'Full Velocity Distribution Comparison', velocity, old_count, new_count "
        "from o_tier_dist",
        "select 'Velocity Reason Distribution Comparison', velocity_reason, old_count, new_count "
        "from o_reason_dist",
    ]
)


@register("exec_summary", _SUMMARY_SQL)
def _(spark, sf_dir):
    return impact.exec_summary(
        analysis_of(spark, sf_dir, "before"),
        analysis_of(spark, sf_dir, "after"),
        cohort_of(spark, sf_dir),
    )


@register("transition_detail", "select * from o_detail")
def _(spark, sf_dir):
    return detail_of(spark, sf_dir)


@register(
    "shift_matrix",
    """select * from o_matrix union all select 'Total', sum(new_a)::bigint, sum(new_b)::bigint,
        sum(new_c)::bigint, sum(new_d)::bigint, sum(new_e)::bigint, sum(total)::bigint
       from o_matrix""",
)
def _(spark, sf_dir):
    return impact.shift_matrix(moved_of(spark, sf_dir))


@register(
    "dc_summary",
    f"""select dc_new as dc, count(*) as records_transitioned, {now_counts()},
        round(coalesce(sum(ss_new), 0) - coalesce(sum(ss_old), 0), 2) + 0.0 as ss_delta_units
       from o_moved where dc_new is not null group by dc_new""",
)
def _(spark, sf_dir):
    return impact.dc_summary(moved_of(spark, sf_dir))


@register(
    "mcat_summary",
    f"""select mcat_new as mcat, count(*) as records_transitioned, {now_counts()}
       from o_moved where mcat_new is not null group by mcat_new""",
)
def _(spark, sf_dir):
    return impact.mcat_summary(moved_of(spark, sf_dir))


for _name, _row, _build in (
    ("pivot_shift", "OLD_PROPOSED_VELOCITY", impact.pivot_shift),
    ("pivot_dc", "DC_NEW", impact.pivot_dc),
    ("pivot_mcat", "MCAT", impact.pivot_mcat),
    ("pivot_reason", "NEW_VELOCITY_REASON", impact.pivot_reason),
):
    register(_name, tier_pivot(_row))(
        lambda spark, sf_dir, build=_build: build(detail_of(spark, sf_dir))
    )

for _name, _row, _build in (
    ("pivot_ss_dc", "DC_NEW", impact.pivot_ss_dc),
    ("pivot_ss_mcat", "MCAT", impact.pivot_ss_mcat),
):
    register(_name, stock_pivot(_row))(
        lambda spark, sf_dir, build=_build: build(detail_of(spark, sf_dir))
    )

__all__ = ["ORACLE", "QUERIES", "analysis_of", "base_of", "driver_tables", "run_of"]
