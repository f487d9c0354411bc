"""Audit and impact operators against pandas and golden rows."""

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tierflow.operators import audit, impact
from tierflow.operators.joins import lookup_join, presence_join
from tierflow.plans import policy, runs
from tierflow.sources.uploads import as_upload

UPLOAD = "JDA_ITEM string, JDA_LOC string, PROPOSED_VELOCITY string"


def upload(spark, data):
    return as_upload(spark.createDataFrame(data, UPLOAD))


def pandas_outer(old, new):
    a = pd.DataFrame(old, columns=["i", "l", "a"])
    b = pd.DataFrame(new, columns=["i", "l", "b"])
    return a.merge(b, on=["i", "l"], how="outer", indicator=True)


def check_diff(spark, old, new):
    merged = pandas_outer(old, new)
    names = {"both": "both", "left_only": "old_only", "right_only": "new_only"}
    want = sorted(
        (i, l, "" if pd.isna(a) else a, "" if pd.isna(b) else b, names[m])
        for i, l, a, b, m in merged.itertuples(index=False, name=None)
    )
    want = [r for r in want if r[4] != "both" or r[2] != r[3]]
    u, v = upload(spark, old), upload(spark, new)
    got = audit.diff_uploads(u, v).select(
        "JDA_ITEM", "JDA_LOC", "proposed_velocity_old", "proposed_velocity_new", "presence"
    )
    assert sorted(tuple(r) for r in got.collect()) == want
    side = [r[4] for r in want]
    assert tuple(audit.diff_summary(u, v).first()) == (
        len(old), len(new), len(want), side.count("old_only"), side.count("new_only"), side.count("both"),
    )


ROWS = st.lists(
    st.tuples(st.sampled_from(["1", "2", "3"]), st.sampled_from(["x", "y"]), st.sampled_from(["A", "B", "a"])),
    min_size=1, max_size=12,
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(ROWS, ROWS)
def test_diff_is_the_outer_merge(spark, old, new):
    check_diff(spark, old, new)


def test_diff_with_one_crowded_key(spark):
    crowd = [("1", "x", "A")] * 40 + [(str(k), "y", "B") for k in range(60)]
    check_diff(spark, crowd, [("1", "x", "B"), ("1", "x", "A"), ("5", "y", "B")])


def test_diff_of_itself_is_empty_and_null_keys_never_meet(spark):
    same = upload(spark, [("1", "x", "A"), ("2", "x", None)])
    assert audit.diff_uploads(same, same).count() == 0
    blank = upload(spark, [(None, "x", "A")])
    assert rows(audit.diff_uploads(blank, blank).select("presence")) == [("new_only",), ("old_only",)]
    assert tuple(audit.diff_summary(blank, blank).first()) == (1, 1, 2, 1, 1, 0)


def test_presence_join_keeps_every_row(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, x string")
    new = spark.createDataFrame([(1, "e"), (1, "f"), (3, "g"), (None, "h")], "k int, y string")
    got = rows(presence_join(old, new, ("k",)))
    assert got == [
        (1, "a", "e", "both"), (1, "a", "f", "both"), (1, "b", "e", "both"), (1, "b", "f", "both"),
        (2, "c", None, "old_only"), (3, None, "g", "new_only"),
        (None, "d", None, "old_only"), (None, None, "h", "new_only"),
    ]


def test_lookup_join_is_a_left_join(spark):
    left = spark.createDataFrame(
        [(1, "a", 1), (2, "a", 2), (None, "a", 3), (None, "a", 4), (1, None, 5)], "k int, m string, id int"
    )
    one = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (None, "a", "z")], "k int, m string, p string")
    two = spark.createDataFrame([(2, "a", "q")], "k int, m string, q string")
    plain = left.join(one, ["k", "m"], "left").join(two, ["k", "m"], "left")
    assert rows(lookup_join(left, [one, two], ("k", "m")).select(plain.columns)) == rows(plain)


def test_validate(spark):
    up = spark.createDataFrame(
        [("1", "x", "A", "9", "u"), ("2", "x", "B", "9", "v"), ("3", "x", None, None, "w"), (" 1", "x", "A", "9", "u")],
        UPLOAD + ", DC string, USN string",
    )
    current = spark.createDataFrame(
        [("1", "x", "A"), ("1", "x", "B"), ("3", "x", None)], "item string, loc string, udc_velocity_code string"
    )
    got = audit.validate(up, current)
    assert rows(got.select("JDA_ITEM", "DCSKU", "Current_Velocity", "Match")) == [
        (" 1", "9u", None, False), ("1", "9u", "A", True), ("1", "9u", "B", False), ("2", "9v", None, False),
        ("3", None, None, False),
    ]
    assert rows(audit.validation_summary(got)) == [("Matches", 1), ("Mismatches", 4), ("Total Records", 5)]
    bare = audit.validate(up.select("JDA_ITEM", "JDA_LOC"), current)
    assert bare.filter("Match").count() == 0 and "DCSKU" not in bare.columns
    assert set(runs.validation_report(up, current)) == {"Velocity Validation", "Summary"}


STATE = "ITEM string, `DC NUMBER` string, VELOCITY string, MCAT string, seq int"


def state(spark):
    return spark.createDataFrame(
        [("1", "x", "B", "m", 1), ("1", "x", "A", "m2", 2), ("2", "x", " C ", "m", 1), ("3", "x", None, None, 5),
         ("6", "x", "D", "m", 1)],
        STATE,
    )


RECS = [("1", "x", "A"), ("2", "x", "D"), ("3", "x", "B"), ("4", "x", "E"), ("5", "x", None), ("6", "x", " d ")]


def test_latest_state_keeps_last(spark):
    got = audit.latest_state(state(spark))
    assert rows(got.select("ITEM", "VELOCITY", "MCAT")) == [
        ("1", "A", "m2"), ("2", " C ", "m"), ("3", None, None), ("6", "D", "m"),
    ]
    with pytest.raises(ValueError):
        audit.latest_state(state(spark).drop("seq"))


def test_apply_status_modes_and_template(spark):
    recs = upload(spark, RECS).withColumn("MCAT", F.lit("from upload"))
    status = audit.apply_status(recs, audit.latest_state(state(spark)))
    assert rows(status.select("ITEM", "status", "parm_velocity", "MCAT")) == [
        ("1", audit.UPDATED, "A", "m2"), ("2", audit.MISMATCH, "C", "m"), ("3", audit.MISMATCH, "", None),
        ("4", audit.MISSING, "", None), ("5", audit.MISSING, "", None), ("6", audit.MISMATCH, "D", "m"),
    ]
    assert tuple(audit.apply_summary(status).first()) == (6, 1, 3, 2, 5, 83.33)
    assert tuple(audit.apply_summary(status.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0)
    sizes = {m: audit.apply_subset(status, m).count() for m in audit.SUBSET_MODES}
    assert sizes == {"not_updated": 5, "missing_only": 2, "mismatch_only": 3, "updated_only": 1}
    with pytest.raises(ValueError):
        audit.apply_subset(status, "all")
    behind = audit.not_updated(status)
    assert behind.columns == [
        "ITEM", "DC NUMBER", "proposed_velocity", "parm_velocity", "SAP_VELOCITY", "SERVICE_LEVEL",
        "VELOCITY_REASON", "status", "MCAT",
    ]
    template = audit.to_template(audit.apply_subset(status))
    assert [r["JDA_ITEM"] for r in audit.sorted_template(template).collect()] == ["2", "3", "4", "5", "6"]
    assert rows(audit.segment_counts(template)) == [
        ("A", 0), ("B", 1), ("C", 0), ("D", 2), ("E", 1), ("Total", 5),
    ]
    report = runs.audit_report(spark.createDataFrame(RECS, UPLOAD), state(spark))
    assert report["summary"].count() == 6 and report["not_updated"].count() == 5


RUN = (
    "jda_item string, jda_loc string, dc string, mcat string, sku_description string, is_forecasted string, "
    "sku_status string, first_receipt_flg string, superseded_sku string, system_velocity string, "
    "new_proposed_velocity string, velocity_change_class string, velocity_reason string, "
    "total_forecasted_qty double, weekly_average_forecasted_qty double, weekly_average_forecasted_dollars double, "
    "velocity_weight double, calculated_velocity_percentile double, proposed_sscov int, "
    "proposed_safety_stock double, safety_stock_change_dollars double, cogs double"
)


def run_row(item, forecasted, status, tier, stock=1.0, dc="1", mcat="m"):
    return (
        item, "x", dc, mcat, "d", forecasted, status, "f", "s", "B", tier, "Match", f"r{tier}",
        1.0, 1.0, 1.0, 1.0, 0.1, 3, stock, 2.0, 5.0,
    )


@pytest.fixture(scope="module")
def two_runs(spark):
    yes, no = "Forecasted", "Not Forecasted"
    old = spark.createDataFrame(
        [
            run_row("stay", yes, "New", "C"), run_row("rank1", yes, "New", "C", 4.0), run_row("rank2", yes, "New", "C", None),
            run_row("rank3", yes, "New", "C"), run_row("idle", yes, "New", "C"), run_row("quiet", yes, "New", "C"),
            run_row("gone", yes, "New", "C"), run_row("odd", yes, "New", "C"), run_row("other", no, "New", "C"),
        ],
        RUN,
    )
    new = spark.createDataFrame(
        [
            run_row("stay", yes, "New", "C"), run_row("rank1", yes, "Not New", "A", 9.0), run_row("rank2", yes, "Not New", "D", 2.0, dc="2"),
            run_row("rank3", yes, "Not New", "D", 3.0, dc=None, mcat=None), run_row("idle", no, "Not New", "E"),
            run_row("quiet", no, "New", "C"), run_row("odd", yes, None, "C"), run_row("fresh", yes, "New", "C"),
            run_row("other", no, "New", "E"),
        ],
        RUN,
    )
    return old, new


def test_transitions(two_runs):
    old, new = two_runs
    cohort = impact.cohort_of(old, new)
    assert {r["jda_item"]: r["transition"] for r in cohort.collect()} == {
        "stay": policy.STAYED, "rank1": policy.TO_RANKED, "rank2": policy.TO_RANKED, "rank3": policy.TO_RANKED,
        "idle": policy.TO_IDLE, "quiet": policy.TO_NEW_UNFORECASTED, "gone": policy.DROPPED,
        "odd": policy.OTHER_TRANSITION,
    }
    assert rows(impact.presence_counts(old, new)) == [("both", 8), ("new_only", 1), ("old_only", 1)]
    summary = {r[0]: (r[1], r[2]) for r in impact.transition_summary(cohort).collect()}
    assert summary[policy.TO_RANKED] == (3, 37.5) and summary[policy.DROPPED] == (1, 12.5)
    assert sum(n for n, _ in summary.values()) == 8
    assert impact.transition_breakdown(cohort).count() == 6


def test_bucket_and_distributions(two_runs):
    old, new = two_runs
    shift = impact.bucket_shift(old, new).first().asDict()
    assert shift["old_new_forecasted"] == 8 and shift["new_new_forecasted"] == 2
    assert shift["net_rows"] == 0 and shift["pct_new_forecasted"] == -75.0
    empty = impact.bucket_shift(old.limit(0), new).first().asDict()
    assert empty["pct_new_forecasted"] is None
    assert rows(impact.tier_dist(old, new)) == [
        ("A", 0, 1), ("B", 0, 0), ("C", 9, 4), ("D", 0, 2), ("E", 0, 2), ("Total", 9, 9),
    ]
    assert rows(impact.reason_dist(old, new)) == [("rA", 0, 1), ("rC", 9, 4), ("rD", 0, 2), ("rE", 0, 2)]


def test_summaries_of_transitioned_rows(two_runs):
    moved = impact.transitioned(impact.cohort_of(*two_runs))
    assert rows(impact.new_tier_dist(moved)) == [
        ("A", 1, 33.3), ("B", 0, 0.0), ("C", 0, 0.0), ("D", 2, 66.7), ("E", 0, 0.0),
    ]
    # sums skip a missing stock on its own side
    assert tuple(impact.ss_impact(moved).first()) == (5.0, 14.0, 6.0, 6.0, 9.0)
    assert rows(impact.dc_summary(moved)) == [("1", 1, 1, 0, 0, 0, 0, 5.0), ("2", 1, 0, 0, 0, 1, 0, 2.0)]
    assert rows(impact.mcat_summary(moved)) == [("m", 2, 1, 0, 0, 1, 0)]
    matrix = {r[0]: tuple(r)[1:] for r in impact.shift_matrix(moved).collect()}
    assert list(matrix) == ["A", "B", "C", "D", "E", "Total"]
    assert matrix["C"] == matrix["Total"] == (1, 0, 0, 2, 0, 3) and matrix["A"] == (0,) * 6


def test_detail_and_pivots(two_runs):
    detail = impact.transition_detail(impact.transitioned(impact.cohort_of(*two_runs)))
    got = {r["JDA_ITEM"]: r for r in detail.collect()}
    assert got["rank1"]["VELOCITY_SHIFT"] == "C -> A" and got["rank1"]["SS_CHANGE_DELTA"] == 5.0
    assert got["rank2"]["SS_CHANGE_DELTA"] is None and got["rank3"]["MCAT"] == "m"
    assert rows(impact.pivot_shift(detail)) == [("C", 1, 0, 0, 2, 0)]
    assert rows(impact.pivot_dc(detail)) == [("1", 1, 0, 0, 0, 0), ("2", 0, 0, 0, 1, 0), (None, 0, 0, 0, 1, 0)]
    assert rows(impact.pivot_mcat(detail)) == [("m", 1, 0, 0, 2, 0)]
    assert rows(impact.pivot_reason(detail)) == [("rA", 1, 0, 0, 0, 0), ("rD", 0, 0, 0, 2, 0)]
    assert rows(impact.pivot_ss_mcat(detail)) == [("m", 5.0, 14.0, 7.0)]
    assert rows(impact.pivot_ss_dc(detail)) == [("1", 4.0, 9.0, 5.0), ("2", None, 2.0, None), (None, 1.0, 3.0, 2.0)]


def test_report_parts(two_runs):
    parts = runs.impact_report(*two_runs)
    assert len(parts) == 12
    summary = parts["Executive Summary"].toPandas()
    assert summary["section"].nunique() == 7
    ranked = summary[summary["metric"] == policy.TO_RANKED].iloc[0]
    assert ranked["value"] == 3 and np.isclose(ranked["detail"], 37.5)


def test_last_row_of_a_report_read_from_file(spark):
    report = spark.createDataFrame([("1", "x", "A", "9"), ("1", "x", "B", "10"), ("2", "x", "C", None)], "ITEM string, `DC NUMBER` string, VELOCITY string, seq string")
    got = audit.latest_state(report).select("ITEM", "VELOCITY")
    assert sorted(map(tuple, got.collect())) == [("1", "B"), ("2", "C")]
    with pytest.raises(Exception, match="order column holds"):
        audit.latest_state(report.withColumn("seq", F.lit("last"))).collect()
