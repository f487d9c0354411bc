"""Crowded keys, copies, replaced tables, odd texts in files, and scans counted in plans."""

import datetime as dt
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tierflow.operators import audit, classify, dims, impact, joins
from tierflow.plans import registered, runs
from tierflow.plans.driver_tables import material_tables
from tierflow.sources import files, registry, sinks, uploads

SF = "/root/testdata/sf0.001"
UPLOAD = "JDA_ITEM string, JDA_LOC string, PROPOSED_VELOCITY string"



def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Keep one row ------------------------------------------------------------------------


def state(spark, data, kind):
    return spark.createDataFrame(data, f"ITEM string, `DC NUMBER` string, VELOCITY string, seq {kind}")


@pytest.mark.parametrize(
    "kind, low, high",
    [
        ("string", "9", "10"), ("string", "2024-02-09", "2024-02-10"), ("string", "2024-02-09 23:59:59.5", "2024-02-10"),
        ("date", dt.date(2024, 2, 9), dt.date(2024, 2, 10)), ("timestamp", dt.datetime(2024, 2, 9, 1), dt.datetime(2024, 2, 9, 2)), ("double", 1.5, 2.5),
    ],
)
def test_last_row_by_numbers_dates_and_times(spark, kind, low, high):
    data = [("1", "a", "A", high), ("1", "a", "B", low), ("1", "a", "C", None), (None, "a", "D", low), (None, "a", "E", high), ("2", None, "F", None)]
    got = rows(audit.latest_state(state(spark, data, kind)))
    assert got == rows(spark.createDataFrame([("1", "a", "A"), (None, "a", "E"), ("2", None, "F")], "ITEM string, d string, v string"))


def test_last_row_ties_and_bad_order(spark):
    data = [("1", "a", "A", "3"), ("1", "a", "B", "3.0"), ("1", "a", None, "3"), ("1", "a", "Z", "")]
    assert rows(audit.latest_state(state(spark, data, "string"))) == [("1", "a", "B")]
    with pytest.raises(Exception, match="the order column holds"):
        audit.latest_state(state(spark, [("1", "a", "A", "soon")], "string")).collect()


def test_one_row_is_kept_before_the_shuffle(spark):
    report = uploads.as_state(material_tables(spark, SF)["state_report"])
    text = plan(audit.latest_state(report)) + plan(dims.vendor_team(material_tables(spark, SF)["vendor_team"]))
    assert "SortAggregate" not in text
    # the first row of each key is kept in every task, then among these
    assert text.count("WindowGroupLimit") == 4 and text.count(", Partial") == text.count(", Final") == 2


def test_first_analyst_of_a_crowded_vendor(spark):
    data = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, "0007").otherwise(F.col("id").cast("string")).alias("vendor"),
        F.when(F.col("id") % 2 > 0, F.format_string("a%05d", 30_000 - F.col("id"))).alias("inventory_analyst"),
        F.col("id").cast("string").alias("manager"),
    )
    got = dims.vendor_team(data)
    assert got.columns == ["vendor", "inventory_analyst", "manager"]
    assert got.where("vendor = '7'").collect()[0].inventory_analyst == "a10001"
    assert got.count() == 1 + 6667


# Diff of counted rows --------------------------------------------------------------------


def test_diff_of_many_copies(spark):
    copies = lambda tier, n: spark.range(n).select(F.lit("1").alias("JDA_ITEM"), F.lit("L").alias("JDA_LOC"), F.lit(tier).alias("PROPOSED_VELOCITY"))
    got = audit.diff_uploads(copies("A", 1000), copies("B", 1000).union(copies("A", 5)))
    assert got.groupBy("proposed_velocity_old", "proposed_velocity_new", "presence").count().collect() == [("A", "B", "both", 1_000_000)]
    assert audit.diff_summary(copies("A", 1000), copies("B", 1000)).first().different_velocity == 1_000_000


def test_diff_beside_a_nested_loop(spark):
    old = [("1", "L", "A"), ("1", "L", "A"), ("1", "L", None), (" 2", "L", "B"), ("3", "L", "C"), (None, "L", "D"), ("4", None, "A"), ("5", "L", "E")]
    new = [("1", "L", "B"), ("1", "L", "a"), ("2", "L ", "B"), ("3", "L", "D"), (None, "L", "D"), ("6", "L", ""), ("6", "L", "")]
    key = lambda r: tuple(x.strip() if x is not None else None for x in r[:2])
    meet = lambda a, b: None not in key(a) and key(a) == key(b)
    want = [(*key(a), a[2] or "", b[2] or "", "both") for a in old for b in new if meet(a, b) and (a[2] or "") != (b[2] or "")]
    want += [(*key(a), a[2] or "", "", "old_only") for a in old if not any(meet(a, b) for b in new)]
    want += [(*key(b), "", b[2] or "", "new_only") for b in new if not any(meet(a, b) for a in old)]
    before, after = spark.createDataFrame(old, UPLOAD), spark.createDataFrame(new, UPLOAD)
    got = audit.diff_uploads(before, after)
    assert rows(got.select("JDA_ITEM", "JDA_LOC", "proposed_velocity_old", "proposed_velocity_new", "presence")) == rows(spark.createDataFrame(want, "a string, b string, c string, d string, e string"))
    counts = audit.diff_summary(before, after).first()
    assert (counts.old_rows, counts.new_rows, counts.changed_rows) == (len(old), len(new), len(want))


def test_diff_reads_each_upload_once(spark, tmp_path):
    for name in ("old", "new"):
        spark.createDataFrame([("1", "L", "A")], UPLOAD).write.parquet(str(tmp_path / name))
    old, new = (spark.read.parquet(str(tmp_path / name)) for name in ("old", "new"))
    for df in (audit.diff_uploads(old, new), audit.diff_summary(old, new)):
        assert plan(df).count("FileScan") == 2 and "Join" not in plan(df)


def test_rows_are_repeated_in_blocks(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7), ("d", 6)], "k string, n long")
    got = joins.repeated(df, "n", at_once=3).groupBy("k").count()
    assert {r.k: r["count"] for r in got.collect()} == {"b": 1, "c": 7, "d": 6}


def test_diff_report(spark, tmp_path):
    old = spark.createDataFrame([("2", "M", "A"), ("1", "L", "A"), ("9", "L", "A")], UPLOAD)
    report = runs.diff_report(old, spark.createDataFrame([("2", "M", "B"), ("1", "L", "A"), ("0", "L", "C")], UPLOAD))
    sinks.write_report(report, str(tmp_path))
    changed = uploads.read_sheet(spark, str(tmp_path), "changes").collect()
    assert [(r.JDA_LOC, r.JDA_ITEM, r.presence) for r in changed] == [("L", "0", "new_only"), ("L", "9", "old_only"), ("M", "2", "both")]
    assert {r.metric: r.value for r in uploads.read_sheet(spark, str(tmp_path), "summary").collect()}["changed_rows"] == "3"


def test_presence_is_counted_without_a_join(spark):
    schema = "jda_item string, jda_loc string"
    old = spark.createDataFrame([("1", "a")] * 3 + [("2", "a"), (None, "a")], schema)
    new = spark.createDataFrame([("1", "a")] * 2 + [("3", "a"), (None, "a"), (None, "a")], schema)
    counts = impact.presence_counts(old, new)
    assert rows(counts) == rows(impact.merge_runs(old, new).groupBy("presence").agg(F.count(F.lit(1)).alias("rows")))
    assert "Join" not in plan(counts)


# Summary ------------------------------------------------------------------------------------


def test_summary_reads_the_runs_twice_and_the_cohort_once(spark):
    text = plan(registered.QUERIES["exec_summary"](spark, SF))
    scans = re.findall(r"FileScan parquet [^\n]*", text)
    assert sum("analysis-before" in s for s in scans) <= 2 and sum("analysis-after" in s for s in scans) <= 2
    assert sum("impact-cohort" in s for s in scans) == 1


# Ranking ------------------------------------------------------------------------------------


def close_weights(spark):
    """One group whose weights all lie within a part in ten thousand of each other."""
    return spark.range(0, 300_000, 1, 8).select(
        F.lit("1").alias("dc"), F.lit("m").alias("mcat"), (5.0 + F.col("id") * 1e-9).alias("velocity_weight")
    )


def test_close_weights_spread_over_tasks(spark, monkeypatch):
    low = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "50KB"}
    old = {k: spark.conf.get(k, None) for k in low}
    staged = []
    keep = classify.stage
    monkeypatch.setattr(classify, "stage", lambda df, name: staged.append(keep(df, name)) or staged[-1])
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        ranks = classify.weight_ranks(close_weights(spark))
        sizes = [r["count"] for r in staged[0].groupBy("rank_group", "bucket").count().collect()]
        assert sum(sizes) == 300_000 and len(sizes) == 8 and max(sizes) < 80_000, sizes
        got = {round((r.velocity_weight - 5.0) * 1e9): r.calculated_velocity_percentile for r in ranks.where("rand(1) < 0.01").collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert all(abs(p - (299_999 - i) / 299_999) < 6e-4 for i, p in got.items()) and len(got) > 2000


def test_ranks_equal_percent_rank(spark):
    weight = F.when(F.col("id") % 17 == 0, None).when(F.col("id") % 5 == 0, 1.0).otherwise(F.sin("id"))
    df = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("string")).alias("dc"), F.lit("m").alias("mcat"), weight.alias("velocity_weight"))
    df.createOrReplaceTempView("ranked_rows")
    want = spark.sql("select id, round(percent_rank() over (partition by dc, mcat order by velocity_weight desc nulls first), 3) p from ranked_rows where velocity_weight is not null or true")
    ranks = classify.weight_ranks(df)
    got = df.alias("a").join(ranks.alias("r"), F.expr("a.dc <=> r.dc and a.mcat <=> r.mcat and a.velocity_weight <=> r.velocity_weight")).select("id", "calculated_velocity_percentile")
    assert rows(got) == rows(want)


# Lookups --------------------------------------------------------------------------------------


def test_a_crowded_lookup_key_is_dealt_out(spark, no_broadcast):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.col("id").cast("string"))
    df = spark.range(30_000).select("id", key.alias("vendor"))
    lookup = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("2", "z"), (None, "n")], "vendor string, name string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = joins.few_valued_join(df, lookup, ("vendor",))
        tasks = [r["count"] for r in out.where("id % 3 < 2").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert rows(out.select("id", "vendor", "name")) == rows(df.join(lookup, "vendor", "left").select("id", "vendor", "name"))
    assert len(tasks) == 8 and max(tasks) < 2.5 * sum(tasks) / 8


# Files ------------------------------------------------------------------------------------------

ODD = ["plain", "two\nlines", 'a "quoted"\r\nline, with comma', "\n", "  outer blanks  ", "back\\slash\\n", '"', "tab\there", "end\n", None]


def test_texts_with_breaks_survive_a_csv(spark, tmp_path):
    df = spark.createDataFrame([(str(i), "L", "A", t) for i, t in enumerate(ODD)], f"{UPLOAD}, NOTE string")
    sinks.write_delta(df.repartition(3), str(tmp_path / "x"))
    got = uploads.read_upload(spark, str(tmp_path / "x"))
    assert {r.JDA_ITEM: r.NOTE for r in got.collect()} == {str(i): t for i, t in enumerate(ODD)}


def test_foreign_csv_with_breaks(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_bytes(b'JDA_ITEM,JDA_LOC,PROPOSED_VELOCITY,NOTE\r\n1,L,A,"one\r\ntwo"\r\n2,L,B,x\r\n')
    got = rows(uploads.read_upload(spark, str(path)).select("JDA_ITEM", "PROPOSED_VELOCITY", "NOTE"))
    # breaks of the kind that ends the lines read as the plain one
    assert got == [("1", "A", "one\ntwo"), ("2", "B", "x")]
    simple = tmp_path / "v.csv"
    simple.write_text("JDA_ITEM,JDA_LOC,PROPOSED_VELOCITY\n1,L,A\n2,L,B\n")
    assert uploads.read_text_table(spark, str(simple), line_breaks=False).count() == 2


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_exports_of_nothing_keep_their_columns(spark, tmp_path, fmt):
    df = spark.createDataFrame([("1", "L", "Missing Data", 5)], "JDA_ITEM string, JDA_LOC string, proposed_velocity string, n int")
    sinks.write_by_tier(df, str(tmp_path / "tiers"), fmt=fmt)
    got = uploads.read_by_tier(spark, str(tmp_path / "tiers"), fmt)
    assert got.count() == 0 and {"JDA_ITEM", "PROPOSED_VELOCITY", "n"} <= set(got.columns)
    sinks.write_report({"none": df.where("n > 5")}, str(tmp_path), fmt)
    assert uploads.read_sheet(spark, str(tmp_path), "none", fmt).columns == df.columns
    sinks.write_by_tier(df.withColumn("proposed_velocity", F.lit("b")), str(tmp_path / "tiers"), fmt=fmt)
    assert rows(uploads.read_by_tier(spark, str(tmp_path / "tiers"), fmt).select("JDA_ITEM", "n")) == [("1", "5")]


def test_a_table_is_replaced_by_rows_read_from_it(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(5).toDF("k"), "", path)
    sinks.write_table(spark.read.parquet(path).where("k > 1"), "", path)
    assert rows(spark.read.parquet(path)) == [(2,), (3,), (4,)]
    with pytest.raises(Exception, match="no good"):
        sinks.write_table(spark.read.parquet(path).select(F.raise_error(F.lit("no good")).alias("k")), "", path)
    assert spark.read.parquet(path).count() == 3
    assert files.children(spark, str(tmp_path))[-1] in ("t",) or all(c.startswith("t") for c in files.children(spark, str(tmp_path)))


def test_a_catalog_table_is_replaced_by_rows_read_from_it(spark):
    spark.sql("drop table if exists tierflow_again")
    sinks.write_table(spark.range(5).toDF("k"), "tierflow_again")
    sinks.write_table(spark.table("tierflow_again").where("k > 1"), "tierflow_again")
    sinks.write_table(spark.table("tierflow_again").where("k > 2"), "tierflow_again")
    assert rows(spark.table("tierflow_again")) == [(3,), (4,)]
    spark.sql("drop table tierflow_again")
    assert not [t.name for t in spark.catalog.listTables() if "staged" in t.name]


def test_a_scope_leaves_nothing_behind(spark):
    top = registry.scratch_dir(spark)
    before = files.children(spark, top)
    with registry.scratch_scope(spark):
        staged = registry.stage(spark.range(3).toDF("k"), "inside")
        once = registry.written_once(spark, "scope-test", "once", lambda: spark.range(2).toDF("k"))
        assert staged.count() == 3 and once.count() == 2
        assert len(files.children(spark, top)) == len(before) + 2
    assert files.children(spark, top) == before
    assert registry.written_once(spark, "scope-test", "once", lambda: spark.range(4).toDF("k")).count() == 4


def test_profile_with_first_rows(spark, tmp_path):
    spark.range(1000).selectExpr("id as k", "cast(id as string) as t").coalesce(1).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    got = registry.profile(df, 3).first()
    assert (got.rows, got.columns, got.column_names) == (1000, 2, "k,t") and [tuple(r) for r in got.first_rows] == [(0, "0"), (1, "1"), (2, "2")]
    assert [tuple(r) for r in registry.head(df, 2).collect()] == [(1, 0, "0"), (2, 1, "1")]
    empty = registry.profile(df.where("k < 0")).first()
    assert (empty.rows, empty.first_rows) == (0, [])
