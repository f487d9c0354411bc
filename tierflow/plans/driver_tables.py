"""The engine's source tables, derived by Spark from the sales tables of a test folder.

Each text is plain SQL that Spark and the checking database read alike, so that
both start from the same rows. Tables in braces are other texts of this module
or the folder's own tables.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tierflow.plans import policy
from tierflow.plans.params import TierParams, material_network, usn_network
from tierflow.sources.registry import Tables, written_once

AS_OF = dt.date(2000, 1, 3)
PARAMS = TierParams(as_of=AS_OF, fiscal_year="FY2000")
HIGH_CUBE = ("Brand#1", "Brand#2", "Brand#3")
MATERIAL = material_network(
    "N1", "coalesced", excluded_plants=("3", "7"), high_cube_categories=HIGH_CUBE
)
MATERIAL_BEFORE = material_network(
    "N1", "no_receipt", excluded_plants=("3", "7"), high_cube_categories=HIGH_CUBE
)
USN = usn_network(
    "N2",
    "recent",
    excluded_warehouses=("3",),
    vendor_managed_regions=("ASIA",),
    high_cube_categories=HIGH_CUBE,
)

BASE = ("nation", "region", "customer", "supplier", "part", "orders", "lineitem")

SQL = {
    "shipments": """
        select cast(s.s_nationkey as string) as dc, s.s_nationkey as n,
               cast(100000 + l.l_partkey as string) as item, l.l_partkey as p,
               l.l_orderkey, l.l_linenumber, l.l_returnflag, l.l_linestatus,
               cast(l.l_shipdate as date) as ship_date,
               l.l_quantity as qty, l.l_extendedprice as price
        from {lineitem} l join {supplier} s on l.l_suppkey = s.s_suppkey""",
    "pairs": "select distinct dc, n, item, p from {shipments}",
    "receipts": f"""
        select dc, n, item, p, min(ship_date) as first_date
        from {{shipments}} where ship_date < date '{AS_OF}' group by dc, n, item, p""",
    # ---- both networks
    "calendar": """
        select distinct ship_date as date_date, cast(ship_date as string) as fiscal_week_id
        from {shipments}""",
    "item_master": """
        select cast(100000 + p_partkey as string) as dmdunit,
               case when p_size % 2 = 0 then 'EA' end as uom,
               p_type as udc_merch_cat_descr,
               'U' || cast(p_partkey as string) as udc_usn_number,
               p_brand as udc_product_cat_descr,
               case when p_size % 4 = 0 then '1' when p_size % 4 = 1 then null else '2' end
                   as udc_import_type,
               p_retailprice as udc_pir_cost
        from {part}""",
    "supersession": """
        select cast(100000 + p_partkey as string) as item,
               case when p_size % 10 = 0 then cast(100000 + p_partkey as string) end as altitem
        from {part}""",
    "usn_receipts": """
        select 'U' || cast(p as string) as usn, dc as warehouse_num,
               first_date as first_receive_date
        from {receipts}""",
    # ---- network of material numbers
    "forecast": "select dc as skuloc, item, ship_date as startdate, qty from {shipments}",
    "plant": """
        select cast(n_nationkey as string) as plant_id,
               cast(n_nationkey as string) as network_plant_id, 'N1' as business_id
        from {nation}""",
    "plant_ext": """
        select cast(n_nationkey as string) as plant_id,
               cast(n_nationkey as string) as network_plant_id, 'N1' as business_id,
               case when n_nationkey = 5 then null else cast(n_regionkey as string) end
                   as dc_region_id
        from {nation}""",
    "catalogue": """
        select q.dc as werks, lpad(q.item, 12, '0') as matnr, t.p_name as maktx,
               t.p_type as mcat_desc, substr(t.p_brand, 7) as mcat_key,
               '2000' || cast(t.p_size as string) as prodcat_key,
               lpad(cast(t.p_size as string), 8, '0') as lifnr, 'ZSTD' as mtpos_mara,
               case when t.p_size % 9 <> 0 then 'Y' else 'N' end as zzstocked, 'X' as eligible
        from {pairs} q join {part} t on q.p = t.p_partkey""",
    "extract": """
        select q.item, q.dc as loc, 'PU' as udc_purch_uom,
               case when (q.p + q.n) % 7 = 0 then null
                    else substr('ABCDE', cast(1 + (q.p + q.n) % 5 as int), 1) end
                   as udc_velocity_code,
               t.p_retailprice as udc_pir_cost
        from {pairs} q join {part} t on q.p = t.p_partkey""",
    "atlas": """
        select dc as plant, lpad(item, 12, '0') as material,
               'V' || cast(p % 97 as string) as vendor
        from {pairs}""",
    "vendor_receipts": """
        select lpad(item, 12, '0') as material_nbr, dc as plant,
               'V' || cast(p % 97 as string) as vendor_nbr,
               first_date as vendor_sku_dc_first_receive_date
        from {receipts}""",
    "item_xref": """
        select 'U' || cast(p_partkey as string) as usn,
               lpad(cast(100000 + p_partkey as string), 12, '0') as material_number
        from {part}""",
    "warehouse_moves": """
        select cast(n_nationkey as string) as source_wh,
               cast((n_nationkey + 1) % 25 as string) as destination_wh,
               case when n_nationkey % 2 = 0 then 'Complete' else 'Planned' end as current_status
        from {nation}""",
    "instock_weekly": """
        select dc as warehouse_number, item, p as sku_id,
               cast(ship_date as string) as fiscal_week_id, 'N1' as network,
               case when l_returnflag <> 'R' then qty end as numerator, qty as denominator
        from {shipments}""",
    "soq": """
        select s.dc as plant, s.item,
               'FY' || cast(year(o.o_orderdate) as string) as orderplace_fy,
               'FW' || lpad(cast(cast(1 + floor((dayofyear(o.o_orderdate) - 1) / 7) as int)
                   as string), 2, '0') as orderplace_fw,
               case when s.l_linenumber = 7 then null else s.qty end as soq
        from {shipments} s join {orders} o on s.l_orderkey = o.o_orderkey""",
    "order_lines": """
        select cast(l_orderkey as string) as vbeln, lpad(item, 12, '0') as matnr,
               case when l_linenumber = 1 then 'N' else 'Y' end as zdel_ready,
               case when l_linenumber = 2 then 'ZTAS' when l_linenumber = 3 then null
                    else 'ZTAN' end as pstyv,
               case when l_returnflag = 'R' then 'ZX' when l_returnflag = 'N' then 'ZF' end
                   as abgru,
               case when n = 9 then 'TX76' end as vstel,
               case when l_linestatus = 'O' and l_linenumber = 4 then 'none'
                    else replace(cast(ship_date as string), '-', '') end as zim_date,
               price as netpr
        from {shipments}""",
    "order_headers": """
        select cast(o.o_orderkey as string) as vbeln, cast(c.c_nationkey as string) as zzdef_werks,
               case o.o_orderpriority when '5-LOW' then 'ZQT' when '4-NOT SPECIFIED' then null
                    else 'ZOR' end as auart
        from {orders} o join {customer} c on o.o_custkey = c.c_custkey""",
    # ---- network of usn numbers
    "u_forecast": """
        select cast(3211 + n as string) as skuloc, item, ship_date as startdate, qty
        from {shipments}""",
    "u_plant": """
        select cast(n_nationkey as string) as plant_id,
               cast(3211 + n_nationkey as string) as network_plant_id, 'N2' as business_id
        from {nation}""",
    "u_extract": """
        select q.item, cast(3211 + q.n as string) as loc, 'PU' as udc_purch_uom,
               case when (q.p + q.n) % 7 = 0 then null
                    else substr('ABCDE', cast(1 + (q.p + q.n) % 5 as int), 1) end
                   as udc_velocity_code,
               t.p_retailprice as udc_pir_cost
        from {pairs} q join {part} t on q.p = t.p_partkey""",
    "u_instock_weekly": """
        select dc as warehouse_number, item, p as sku_id,
               cast(ship_date as string) as fiscal_week_id, 'N2' as network,
               case when l_returnflag <> 'R' then qty end as numerator, qty as denominator
        from {shipments}""",
    "u_soq": """
        select cast(3211 + cast(plant as int) as string) as plant, item, orderplace_fy,
               orderplace_fw, soq
        from {soq}""",
    "assortment": """
        select q.dc as warehouse_number, 'U' || cast(q.p as string) as usn,
               t.p_name as item_description,
               case when t.p_size % 9 = 0 then 'Obsolete' else 'Replenished' end as ipr_category
        from {pairs} q join {part} t on q.p = t.p_partkey""",
    "inventory_master": """
        select distinct case when l_linestatus = 'F' then 'U' else 'X' end || cast(p as string)
               as usn, dc as warehouse_number
        from {shipments}""",
    "dim_warehouse": """
        select cast(n_nationkey as string) as warehouse_num, n_nationkey as warehouse_id
        from {nation}""",
    "warehouse": """
        select n_nationkey as warehouse_id,
               case when n_nationkey = 7 then 0 when n_nationkey = 11 then null else 1 end
                   as is_open_for_operations
        from {nation}""",
    "sku": """
        select p_partkey as sku_id, p_size as taxonomy_id,
               'U' || cast(p_partkey as string) as usn
        from {part}""",
    "taxonomy": """
        select distinct p_size as taxonomy_id, p_size % 10 as taxonomy_level_1_id,
               ' l' || cast(p_size as string) as taxonomy_level_2_id
        from {part}""",
    "open_warehouse": """
        select n.n_nationkey as warehouse_id, cast(n.n_nationkey as string) as warehouse_num,
               r.r_name as region_name, n.n_nationkey <> 4 as is_open_for_operations
        from {nation} n join {region} r on n.n_regionkey = r.r_regionkey""",
    "plant_names": """
        select case when n_regionkey = 2 then 'WX' else 'W' end
                   || lpad(cast(n_nationkey as string), 2, '_') || '_' || n_name as name1,
               cast(3211 + n_nationkey as string) as werks
        from {nation}""",
    "location": """
        select cast(3211 + n_nationkey as string) as loc,
               cast(n_nationkey as string) || ' - ' || n_name as descr
        from {nation}""",
    "sales": """
        select p as sku_id, n as shipping_warehouse_id, price as net_amt, qty as shipped_qty,
               ship_date as create_date
        from {shipments}""",
    # ---- inputs of single operators, and the lookups
    "vendor_team": """
        select lpad(cast(s_nationkey as string), 6, '0') as vendor, s_name as inventory_analyst,
               'M' || cast(s_suppkey as string) as manager
        from {supplier}""",
    "category_ref": """
        select 'L' || cast(p_size as string) as material_level1_code,
               'L' || cast(p_size as string) as material_level2_code,
               'N1|0' || '2000' as mcat_id, 'N1|' || cast(p_size as string) as pcat_id,
               case when p_size % 6 = 5 then null else 'D' || cast(p_size % 10 as string) end as dmm,
               case when p_size < 15 then 'R' || cast(p_size as string) end as reporting_merchant,
               case when p_size < 30 then 'S' || cast(p_size % 4 as string) end as sr_merchant,
               case when p_size > 45 then 'N2' else 'N1' end as source,
               p_size <> 7 as is_current
        from {part}""",
    "customer_locations": """
        select cast(3000 + c_custkey as string) as loc,
               cast(c_nationkey as string) || ' - ' || c_name as descr
        from {customer}""",
    "supplier_names": """
        select 'W' || lpad(cast(s_nationkey as string), 2, '_') || '_' || s_name as name1,
               cast(s_suppkey as string) as werks
        from {supplier}""",
    "supplier_items": """
        select 'U' || cast(p as string) as iitem, 'E' || cast(n as string) as iwhse,
               case l_linenumber
                   when 1 then 'abcon1' when 2 then '8000072C' when 3 then null
                   when 4 then 'xSV' || cast(n as string)
                   when 5 then 'mt' || cast(p % 25 as string) || 'T1'
                   when 6 then 'W0' || cast(p % 25 as string) || 'TW13'
                   else '5ABC' end as isupv,
               case when l_returnflag = 'R' then 1 else 0 end as iactv
        from {shipments}""",
    "warehouse_lookup": """
        select cast(n_nationkey as string) as warehouse_num,
               'E' || cast(n_nationkey as string) as warehouse_num_e3
        from {nation}""",
    "category_xref": """
        select distinct 'N1|' || lpad(substr(p_brand, 7), 2, '0') as mcat_id from {part}
        union
        select distinct case when p_size % 10 = 3 then 'OLD|' else 'PRO|' end
               || cast(p_size % 10 as string) from {part}""",
    "atp": """
        select dc as werks, matnr, sum(qty) as atp_qty from (
            select dc, qty, case when l_linestatus = 'O' then lpad(item, 12, '0')
                   else 'X' || item end as matnr
            from {shipments}) s group by dc, matnr""",
    "location_hierarchy": """
        select cast(n_nationkey as string) as werks, 'N1' as business_id,
               cast(n_regionkey as string) as svcg_linehaul
        from {nation}""",
    "instock_view": """
        select dc as werks, matnr, max(qty) as instock_units from (
            select dc, qty, case when l_returnflag = 'N' then item else 'X' || item end as matnr
            from {shipments}) s group by dc, matnr""",
    "catalogue_plan": f"""
        select dc, material, min(l_returnflag) as plan_code from (
            select dc, l_returnflag, case when ship_date >= date '{AS_OF}' then item
                   else 'X' || item end as material
            from {{shipments}}) s group by dc, material""",
    "storage_type": """
        select case when t.p_size > 25 then 'U' else 'X' end || cast(q.p as string) as usn,
               q.dc as warehouse_num, t.p_brand as storage_type
        from {pairs} q join {part} t on q.p = t.p_partkey""",
    # the report of the system's state: one line per shipment, the last one counts;
    # one region reports under numbers that no recommendation has
    "state_report": """
        select s.item as ITEM,
               case when r.r_name = 'EUROPE' then '9' || s.dc else s.dc end as `DC NUMBER`,
               substr('ABCDE', cast(1 + s.qty as int) % 5 + 1, 1) as VELOCITY,
               t.p_name as `ITEM DESCRIPTION`, t.p_type as MCAT, t.p_brand as PCAT,
               s.l_orderkey * 10 + s.l_linenumber as seq
        from {shipments} s join {part} t on s.p = t.p_partkey
             join {nation} n on s.n = n.n_nationkey
             join {region} r on n.n_regionkey = r.r_regionkey""",
}

USN_NAMES = {
    "forecast": "u_forecast",
    "plant": "u_plant",
    "extract": "u_extract",
    "instock_weekly": "u_instock_weekly",
    "soq": "u_soq",
}


#: Texts that Spark builds from narrower rows; the rows are those of SQL. (n, p) stands for
#: (dc, item), so one pass groups the shipments for three tables, and joins carry numbers.
NARROW = {
    "dated_pairs": f"""
        select n, p, min(case when ship_date < date '{AS_OF}' then ship_date end) as first_date,
               bool_or(coalesce(l_linestatus = 'F', false)) as closed,
               bool_or(coalesce(l_linestatus <> 'F', true)) as not_closed
        from {{shipments}} group by n, p""",
    "pairs": """
        select cast(n as string) as dc, n, cast(100000 + p as string) as item, p
        from {dated_pairs}""",
    "receipts": """
        select cast(n as string) as dc, n, cast(100000 + p as string) as item, p, first_date
        from {dated_pairs} where first_date is not null""",
    # without a part both kinds are the same null usn, which counts once
    "inventory_master": """
        select 'U' || cast(p as string) as usn, cast(n as string) as warehouse_number
        from {dated_pairs} where closed
        union all
        select 'X' || cast(p as string) as usn, cast(n as string) as warehouse_number
        from {dated_pairs} where not_closed and not (closed and p is null)""",
}

#: Tables that are kept as files: those that cost a shuffle, and two whose scans take filters.
#: The rest are projections of these and of the folder's tables, read as such.
STORED = (
    "dated_pairs",
    "calendar",
    "forecast",
    "catalogue",
    "extract",
    "soq",
    "order_headers",
    "u_extract",
    "assortment",
    "taxonomy",
    "category_xref",
    "atp",
    "instock_view",
    "catalogue_plan",
    "storage_type",
)


def spark_text(name: str) -> str:
    """The text by which Spark builds a table: keys become text above a join, not below it."""
    if name in NARROW:
        return NARROW[name]
    text = re.sub(r"(select |as plant, )([qs])\.item,", r"\1cast(100000 + \2.p as string) as item,", SQL[name])
    text = re.sub(r"\b([qs])\.item\b", r"cast(100000 + \1.p as string)", text)
    return re.sub(r"\b([qs])\.dc\b", r"cast(\1.n as string)", text)


def references(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def driver_tables(
    spark: SparkSession, sf_dir: str, names: dict[str, str] | None = None
) -> Tables:
    """Tables of one network by logical name; ``names`` maps to another text.

    A text that costs a shuffle is written once per session and folder, when a query first
    asks for it; a projection of others is left to its reader, whose filters and columns
    reach the files below it.
    """

    def built(name: str) -> DataFrame:
        text = spark_text(name)
        if name == "shipments" and frames["supplier"].count() <= policy.FEW_ROWS:
            # two numbers of a supplier: each executor holds them, and no reader shuffles the lines for them
            text = text.replace("select", "select /*+ broadcast(s) */", 1)

        def build() -> DataFrame:
            return spark.sql(text, **{r: frames[r] for r in references(text)})

        if name not in STORED:
            return build()
        return written_once(spark, f"{sf_dir}/{name}", name.replace("_", "-"), build)

    sources = {name: {"path": f"{sf_dir}/{name}.parquet"} for name in BASE}
    frames = Tables(spark, sources | {name: partial(built, name) for name in SQL | NARROW})
    if not names:
        return frames
    renamed = {
        logical: partial(frames.__getitem__, actual) for logical, actual in names.items()
    }
    kept = {name: partial(frames.__getitem__, name) for name in frames if name not in renamed}
    return Tables(spark, kept | renamed)


def material_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return driver_tables(spark, sf_dir)


def usn_tables(spark: SparkSession, sf_dir: str) -> Tables:
    return driver_tables(spark, sf_dir, USN_NAMES)


__all__ = [
    "AS_OF",
    "MATERIAL",
    "MATERIAL_BEFORE",
    "PARAMS",
    "SQL",
    "USN",
    "driver_tables",
    "material_tables",
    "references",
    "usn_tables",
]
