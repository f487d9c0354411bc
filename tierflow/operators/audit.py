"""Validation of uploads, diff of two uploads, and whether recommendations were applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.functions import text
from tierflow.operators.joins import BOTH, NEW_ONLY, OLD_ONLY, first_row, repeated
from tierflow.plans import policy

MISSING, MISMATCH, UPDATED = "MISSING_IN_PARM", "NOT_UPDATED_MISMATCH", "UPDATED_MATCH"

SUBSET_MODES = {
    "not_updated": (MISSING, MISMATCH),
    "missing_only": (MISSING,),
    "mismatch_only": (MISMATCH,),
    "updated_only": (UPDATED,),
}

KEYS = policy.UPLOAD_KEYS


# ---- lookup validation ----------------------------------------------------------------------


def validate(upload: DataFrame, current: DataFrame) -> DataFrame:
    """Upload rows with the system's current tier, the dc-sku label and the match flag.

    Keys are compared as they are, untrimmed; a key the system holds twice gives two rows.
    """
    system = current.select(
        F.col("item").cast("string").alias("JDA_ITEM"),
        F.col("loc").cast("string").alias("JDA_LOC"),
        F.col("udc_velocity_code").alias("Current_Velocity"),
    )
    keyed = upload.withColumns({k: F.col(k).cast("string") for k in KEYS})
    rows = dcsku(keyed.join(system, list(KEYS), "left"))
    return rows.withColumn("Match", match_flag(rows.columns))


def dcsku(df: DataFrame) -> DataFrame:
    """Adds the dc and usn as one label where both columns exist."""
    if {"DC", "USN"} <= set(df.columns):
        return df.withColumn("DCSKU", F.concat(F.col("DC").cast("string"), F.col("USN").cast("string")))
    return df


def match_flag(columns: list[str]) -> Column:
    """True where current and proposed tier are known and equal."""
    if "PROPOSED_VELOCITY" not in columns:
        return F.lit(False)
    return F.coalesce(F.col("Current_Velocity") == F.col("PROPOSED_VELOCITY"), F.lit(False))


def validation_summary(validated: DataFrame) -> DataFrame:
    """Statistic and count: all rows, matches, mismatches."""
    totals = validated.agg(
        F.count(F.lit(1)).alias("Total Records"),
        F.count_if("Match").alias("Matches"),
        F.count_if(~F.col("Match")).alias("Mismatches"),
    )
    return metric_rows(totals, "statistic", "count")


def metric_rows(one_row: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """A one-row frame of numbers as one row per column."""
    return one_row.unpivot([], list(one_row.columns), name, value)


# ---- diff of two uploads --------------------------------------------------------------------


def _tier_by_key(upload: DataFrame, name: str) -> DataFrame:
    return upload.select(
        *[F.trim(F.col(k)).alias(k) for k in KEYS], text("PROPOSED_VELOCITY").alias(name)
    )


def counted_sides(old: DataFrame, new: DataFrame, keys: tuple[str, ...], *values: str) -> DataFrame:
    """old_n and new_n, the rows of both frames by key and values, with each frame read once.

    A null key meets no other, so its two sides are kept ``apart``.
    """
    sides = old.select(*keys, *values).withColumn("side", F.lit("old")).unionByName(
        new.select(*keys, *values).withColumn("side", F.lit("new"))
    )
    keyless = F.lit(False)
    for k in keys:
        keyless = keyless | F.col(k).isNull()
    return sides.groupBy(*keys, F.when(keyless, F.col("side")).otherwise("").alias("apart"), *values).agg(
        F.count_if(F.col("side") == "old").alias("old_n"), F.count_if(F.col("side") == "new").alias("new_n")
    )


def diff_uploads(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys on one side only, and keys whose tier differs; case counts.

    Rows are counted by key and tier first. Each pair of unlike tiers of a key is then
    repeated by the product of its counts, so copies meet as numbers, not as rows, and a key
    holds as many entries as it has different tiers.
    """
    counts = counted_sides(_tier_by_key(old, "tier"), _tier_by_key(new, "tier"), KEYS, "tier")
    side = lambda n: F.collect_list(F.when(F.col(n) > 0, F.struct("tier", F.col(n).alias("n"))))
    by_key = counts.groupBy(*KEYS, "apart").agg(side("old_n").alias("before"), side("new_n").alias("after"))

    def pair(presence: str, before: Column, after: Column, old_n: Column, new_n: Column) -> Column:
        return F.struct(
            before.alias("proposed_velocity_old"), after.alias("proposed_velocity_new"),
            old_n.alias("old_n"), new_n.alias("new_n"), F.lit(presence).alias("presence"),
        )

    one, blank = F.lit(1).cast("long"), F.lit("")
    unlike = F.flatten(F.transform("before", lambda a: F.transform(
        F.filter("after", lambda b: b["tier"] != a["tier"]), lambda b: pair(BOTH, a["tier"], b["tier"], a["n"], b["n"])
    )))
    gone = F.transform("before", lambda a: pair(OLD_ONLY, a["tier"], blank, a["n"], one))
    come = F.transform("after", lambda b: pair(NEW_ONLY, blank, b["tier"], one, b["n"]))
    pairs = F.when(F.size("after") == 0, gone).when(F.size("before") == 0, come).otherwise(unlike)
    rows = by_key.select(*KEYS, F.inline(pairs))
    return repeated(repeated(rows, "old_n"), "new_n")


def sorted_diff(diff: DataFrame) -> DataFrame:
    """Report order: location, then item."""
    return diff.orderBy("JDA_LOC", "JDA_ITEM")


def diff_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sizes of both uploads and counts of the diff, as one row.

    The counts come from tiers counted by key: no row pair is built, and a key
    that repeats shrinks before its rows meet.
    """
    by_tier = counted_sides(_tier_by_key(old, "tier"), _tier_by_key(new, "tier"), KEYS, "tier")
    by_key = by_tier.groupBy(*KEYS, "apart").agg(
        F.sum("old_n").alias("old_n"),
        F.sum("new_n").alias("new_n"),
        F.sum(F.col("old_n") * F.col("new_n")).alias("same"),
    )
    zero = F.lit(0).cast("long")
    counts = by_key.agg(
        F.coalesce(F.sum("old_n"), zero).alias("old_rows"),
        F.coalesce(F.sum("new_n"), zero).alias("new_rows"),
        F.coalesce(F.sum(F.when(F.col("new_n") == 0, F.col("old_n"))), zero).alias("only_in_old"),
        F.coalesce(F.sum(F.when(F.col("old_n") == 0, F.col("new_n"))), zero).alias("only_in_new"),
        F.coalesce(F.sum(F.col("old_n") * F.col("new_n") - F.col("same")), zero).alias(
            "different_velocity"
        ),
    )
    changed = F.col("only_in_old") + F.col("only_in_new") + F.col("different_velocity")
    return counts.select(
        "old_rows",
        "new_rows",
        changed.alias("changed_rows"),
        "only_in_old",
        "only_in_new",
        "different_velocity",
    )


# ---- were the recommendations applied? ------------------------------------------------------


def _order_value(column: Column, kind: str) -> Column:
    """The order column as a number or time; text holds numbers, dates or times.

    10 comes after 9 in text too, and a text that is no number counts by its microseconds.
    """
    if kind != "string":
        return column
    shown = F.trim(column)
    number = shown.try_cast("decimal(38,9)")
    time = F.unix_micros(shown.try_cast("timestamp")).cast("decimal(38,9)")
    bad = F.raise_error(F.concat(F.lit("the order column holds "), column)).cast("decimal(38,9)")
    return F.when(column.isNull() | (shown == ""), None).otherwise(F.coalesce(number, time, bad))


def latest_state(report: DataFrame, seq: str = "seq") -> DataFrame:
    """Last row per (item, dc) by ``seq``, which the report must carry; nulls come first.

    ``seq`` is a number, a date or a time, or text of these. Rows of equal ``seq`` fall back
    on their other columns, so the answer does not change from run to run. Each task first
    keeps the last row of each of its keys; these few meet by key after the shuffle.
    """
    if seq not in report.columns:
        raise ValueError(f"the report has no order column {seq!r}")
    keys = ["ITEM", "DC NUMBER"]
    rest = [c for c in report.columns if c not in (*keys, seq)]
    order = _order_value(F.col(f"`{seq}`"), dict(report.dtypes)[seq])
    rows = report.select(*[F.col(f"`{c}`") for c in (*keys, *rest)], order.alias("__order"))
    last = [F.col(c).desc_nulls_last() for c in ("__order", *(f"`{c}`" for c in rest))]
    return first_row(rows, keys, last).drop("__order")


def apply_status(recommendations: DataFrame, state: DataFrame) -> DataFrame:
    """Recommendations with the live tier and whether it is the proposed one.

    A descriptive column on both sides is taken from the state report.
    """
    details = [c for c in policy.STATE_DETAIL_HEADERS if c in state.columns]
    live = state.select(
        "ITEM",
        F.col("`DC NUMBER`"),
        F.col("VELOCITY").alias("live_velocity"),
        F.lit(True).alias("in_state"),
        *[F.col(f"`{c}`") for c in details],
    )
    recs = recommendations.drop(*details, "VELOCITY").withColumnsRenamed(
        {"JDA_ITEM": "ITEM", "JDA_LOC": "DC NUMBER"}
    )
    return (
        recs.withColumn("proposed_tier", text("PROPOSED_VELOCITY"))
        .join(live, ["ITEM", "DC NUMBER"], "left")
        .withColumn("parm_velocity", text("live_velocity"))
        .withColumn(
            "status",
            F.when(F.col("in_state").isNull(), MISSING)
            .when(F.col("parm_velocity") != F.col("proposed_tier"), MISMATCH)
            .otherwise(UPDATED),
        )
        .drop("live_velocity", "in_state")
    )


def not_updated(status: DataFrame) -> DataFrame:
    """Missing or mismatched recommendations with the columns on hand, in report order."""
    wanted = [
        "ITEM",
        "DC NUMBER",
        "proposed_velocity",
        "parm_velocity",
        "SAP_VELOCITY",
        "SERVICE_LEVEL",
        "VELOCITY_REASON",
        "status",
        *policy.STATE_DETAIL_HEADERS,
    ]
    rows = status.filter(F.col("status").isin(*SUBSET_MODES["not_updated"]))
    rows = rows.drop("PROPOSED_VELOCITY").withColumnRenamed("proposed_tier", "proposed_velocity")
    return rows.select(*[F.col(f"`{c}`") for c in wanted if c in rows.columns])


def sorted_not_updated(rows: DataFrame) -> DataFrame:
    """Report order: dc, then item."""
    return rows.orderBy(F.col("`DC NUMBER`"), "ITEM")


def apply_summary(status: DataFrame) -> DataFrame:
    """Totals by status and the share not updated, as one row."""
    counts = status.agg(
        F.count(F.lit(1)).alias("thursday_rows"),
        F.count_if(F.col("status") == UPDATED).alias("updated_match_rows"),
        F.count_if(F.col("status") == MISMATCH).alias("not_updated_mismatch_rows"),
        F.count_if(F.col("status") == MISSING).alias("missing_in_parm_rows"),
    )
    behind = F.col("not_updated_mismatch_rows") + F.col("missing_in_parm_rows")
    share = F.when(F.col("thursday_rows") == 0, F.lit(0.0)).otherwise(
        F.round(behind / F.col("thursday_rows") * 100.0, 2)
    )
    return counts.withColumns({"not_updated_total_rows": behind, "pct_not_updated": share})


def apply_subset(status: DataFrame, mode: str = "not_updated") -> DataFrame:
    """Recommendations of one mode."""
    if mode not in SUBSET_MODES:
        raise ValueError(f"mode {mode!r} is not one of {sorted(SUBSET_MODES)}")
    return status.filter(F.col("status").isin(*SUBSET_MODES[mode]))


def to_template(subset: DataFrame) -> DataFrame:
    """Upload template: the live tier as system tier, the earlier one kept beside it."""
    return subset.select(
        text("ITEM").alias("JDA_ITEM"),
        text("`DC NUMBER`").alias("JDA_LOC"),
        text("PROPOSED_VELOCITY").alias("PROPOSED_VELOCITY"),
        text("PROPOSED_VELOCITY_").alias("PROPOSED_VELOCITY_"),
        text("SERVICE_LEVEL").alias("SERVICE_LEVEL"),
        text("parm_velocity").alias("SAP_VELOCITY"),
        text("VELOCITY_REASON").alias("VELOCITY_REASON"),
        text("SAP_VELOCITY").alias("Old_Proposed_Velocity"),
    )


def sorted_template(rows: DataFrame) -> DataFrame:
    """Report order: location, then item."""
    return rows.orderBy("JDA_LOC", "JDA_ITEM")


def segment_counts(rows: DataFrame, column: str = "PROPOSED_VELOCITY") -> DataFrame:
    """Rows per tier A to E, zeros included, and over all; another tier counts only there."""
    tier = F.upper(F.trim(F.col(column)))
    totals = rows.agg(
        *[F.count_if(tier == t).alias(t) for t in policy.TIERS], F.count(F.lit(1)).alias("Total")
    )
    return metric_rows(totals, "segment", "rows")


__all__ = [
    "BOTH",
    "NEW_ONLY",
    "OLD_ONLY",
    "apply_status",
    "apply_subset",
    "apply_summary",
    "counted_sides",
    "dcsku",
    "diff_summary",
    "diff_uploads",
    "latest_state",
    "match_flag",
    "metric_rows",
    "not_updated",
    "segment_counts",
    "sorted_diff",
    "sorted_not_updated",
    "sorted_template",
    "to_template",
    "validate",
    "validation_summary",
]
