"""What the planner makes of the runs."""

import re

import pytest
from pyspark.sql import functions as F

from tierflow.operators import classify, dims
from tierflow.plans import registered
from tierflow.plans.driver_tables import AS_OF, MATERIAL, PARAMS, USN, material_tables, usn_tables
from tierflow.plans.runs import active_universe

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["analysis_material", "analysis_usn", "diff_uploads", "exec_summary", "latest_state"])
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(registered.QUERIES[name](spark, SF))
    for word in ("Python", "Pandas", "CartesianProduct"):
        assert word not in text, word


def test_catalogue_conditions_reach_the_scan(spark):
    text = plan(active_universe(material_tables(spark, SF), PARAMS, MATERIAL, "material"))
    scan = next(s for s in re.findall(r"FileScan parquet \[werks[^\n]*", text) if "maktx" in s)
    assert "EqualTo(zzstocked,Y)" in scan and "EqualTo(eligible,X)" in scan
    usn = plan(active_universe(usn_tables(spark, SF), PARAMS, USN, "usn"))
    scan = next(s for s in re.findall(r"FileScan parquet [^\n]*", usn) if "ipr_category" in s)
    assert "IsNotNull(ipr_category)" in scan


def test_assortment_meets_one_table_of_warehouses(spark):
    """Of the joins on warehouse keys alone, one has the assortment below it."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = active_universe(usn_tables(spark, SF), PARAMS, USN, "usn")
        text = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = text.splitlines()
    depth = [len(re.match(r"[\s:|+\-]*", s).group()) for s in lines]
    over = 0
    for i, s in enumerate(lines):
        keyed = "Join " in s and re.search(r"(warehouse_number|warehouse_id|open_num)#\d+L? = \1#", s)
        if not keyed or re.search(r"(usn|sku_id)#\d+L? = \1#", s):
            continue
        below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        over += any("ipr_category" in x for x in lines[i:below])
    assert over == 1


def test_forecast_scan_prunes_and_filters(spark):
    t = material_tables(spark, SF)
    text = plan(dims.forecast_window(t["forecast"], t["plant"], "N1", AS_OF))
    scan = next(s for s in re.findall(r"FileScan parquet [^\n]*", text) if "skuloc" in s)
    assert "GreaterThanOrEqual(startdate" in scan and "LessThanOrEqual(startdate" in scan


def test_ranking_windows_are_cut_below_the_group(spark):
    base = registered.base_of(spark, SF, "after")
    text = plan(classify.classify(base, PARAMS))
    assert "percent_rank" not in text and "SinglePartition" not in text
    # the window over the rows themselves is within a bucket, never within a whole group
    windows = re.findall(r"Window \[sum\(n#\d+L?\)[^\n]*", text)
    assert windows and all("bucket" in w for w in windows)


def test_distinct_needs_no_shuffle_of_its_own(spark):
    """With sort-merge joins the rows are already placed by item and dc."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(active_universe(material_tables(spark, SF), PARAMS, MATERIAL, "material"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    top = text.split("SortMergeJoin")[0]
    assert top.count("HashAggregate") + top.count("SortAggregate") >= 2 and "Exchange" not in top


def test_a_crowded_weight_is_split(spark):
    """A third of all rows share one weight; with low limits the join on it is cut up."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    old = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        weight = F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double"))
        rows = spark.range(0, 300_000, 1, 8).select(
            F.lit("1").alias("dc"),
            F.lit("m").alias("mcat"),
            F.sha2(F.col("id").cast("string"), 256).alias("item"),
            weight.alias("velocity_weight"),
        )
        ranked = classify.tier_percentile(rows)
        executed = ranked._jdf.queryExecution().executedPlan()
        executed.execute().count()
        text = executed.toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in text and "AQEShuffleRead skewed" in text
