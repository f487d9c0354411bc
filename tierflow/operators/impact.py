"""Before/after analysis of two runs. ``old`` and ``new`` are analysis tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.operators.audit import counted_sides
from tierflow.operators.joins import BOTH, NEW_ONLY, OLD_ONLY, presence_join
from tierflow.plans import policy

KEYS = ("jda_item", "jda_loc")
TIERS = policy.TIERS

#: Columns of the detail by their source in the merged runs.
DETAIL = {
    "JDA_ITEM": "jda_item",
    "JDA_LOC": "jda_loc",
    "DC_OLD": "dc_old",
    "DC_NEW": "dc_new",
    "MCAT": "mcat_old",
    "SKU_DESCRIPTION": "sku_description_old",
    "OLD_SKU_STATUS": "sku_status_old",
    "NEW_SKU_STATUS": "sku_status_new",
    "OLD_IS_FORECASTED": "is_forecasted_old",
    "NEW_IS_FORECASTED": "is_forecasted_new",
    "OLD_FIRST_RECEIPT_FLG": "first_receipt_flg_old",
    "NEW_FIRST_RECEIPT_FLG": "first_receipt_flg_new",
    "SUPERSEDED_SKU": "superseded_sku_old",
    "SYSTEM_VELOCITY": "system_velocity_old",
    "OLD_PROPOSED_VELOCITY": "new_proposed_velocity_old",
    "NEW_PROPOSED_VELOCITY": "new_proposed_velocity_new",
    "OLD_VELOCITY_REASON": "velocity_reason_old",
    "NEW_VELOCITY_REASON": "velocity_reason_new",
    "OLD_VELOCITY_CHANGE_CLASS": "velocity_change_class_old",
    "NEW_VELOCITY_CHANGE_CLASS": "velocity_change_class_new",
    "NEW_VELOCITY_WEIGHT": "velocity_weight_new",
    "NEW_VELOCITY_PERCENTILE": "calculated_velocity_percentile_new",
    "TOTAL_FORECASTED_QTY_NEW": "total_forecasted_qty_new",
    "WEEKLY_AVG_FCST_QTY_NEW": "weekly_average_forecasted_qty_new",
    "WEEKLY_AVG_FCST_DOLLARS_NEW": "weekly_average_forecasted_dollars_new",
    "OLD_PROPOSED_SSCOV": "proposed_sscov_old",
    "NEW_PROPOSED_SSCOV": "proposed_sscov_new",
    "OLD_PROPOSED_SS": "proposed_safety_stock_old",
    "NEW_PROPOSED_SS": "proposed_safety_stock_new",
    "OLD_SS_CHANGE_DOLLARS": "safety_stock_change_dollars_old",
    "NEW_SS_CHANGE_DOLLARS": "safety_stock_change_dollars_new",
    "COGS": "cogs_new",
}


# ---- merge and cohort -----------------------------------------------------------------------


def merge_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer merge on item and location; other columns end in _old or _new."""

    def suffixed(df: DataFrame, end: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{c}_{end}" for c in df.columns if c not in KEYS})

    return presence_join(suffixed(old, "old"), suffixed(new, "new"), KEYS)


def presence_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merged rows by presence, counted by key without a join; a presence without rows is left out."""
    n = {"old": F.col("old_n"), "new": F.col("new_n")}
    sizes = counted_sides(old, new, KEYS).select(
        F.inline(
            F.array(
                F.struct(F.lit(BOTH).alias("presence"), (n["old"] * n["new"]).alias("rows")),
                F.struct(F.lit(OLD_ONLY).alias("presence"), F.when(n["new"] == 0, n["old"]).otherwise(0).alias("rows")),
                F.struct(F.lit(NEW_ONLY).alias("presence"), F.when(n["old"] == 0, n["new"]).otherwise(0).alias("rows")),
            )
        )
    )
    return sizes.groupBy("presence").agg(F.sum("rows").alias("rows")).where("rows > 0")


def _new_forecasted(end: str = "") -> Column:
    return (F.col(f"sku_status{end}") == "New") & (
        F.col(f"is_forecasted{end}") == "Forecasted"
    )


def was_new_forecasted(merged: DataFrame) -> DataFrame:
    """Rows that were new and forecasted in the old run."""
    return merged.filter(_new_forecasted("_old"))


def transition(cohort: DataFrame) -> DataFrame:
    """Adds where each row of the cohort went in the new run."""
    status, forecasted = F.col("sku_status_new"), F.col("is_forecasted_new")
    new, old = status == "New", status == "Not New"
    yes, no = forecasted == "Forecasted", forecasted == "Not Forecasted"
    return cohort.withColumn(
        "transition",
        F.when(F.col("presence") == OLD_ONLY, policy.DROPPED)
        .when(new & yes, policy.STAYED)
        .when(old & yes, policy.TO_RANKED)
        .when(new & no, policy.TO_NEW_UNFORECASTED)
        .when(old & no, policy.TO_IDLE)
        .otherwise(policy.OTHER_TRANSITION),
    )


def cohort_of(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old run's new and forecasted rows with their transition."""
    return transition(was_new_forecasted(merge_runs(old, new)))


def reported(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both runs with the columns that the report reads of the cohort.

    The merge moves each row of the new run, so what nobody reads is left out before it.
    """

    def narrow(df: DataFrame, end: str) -> DataFrame:
        read = {*KEYS, *[c.removesuffix(end) for c in (*DETAIL.values(), *STOCK.values(), "mcat_new") if c.endswith(end)]}
        return df.select(*[c for c in df.columns if c in read])

    return narrow(old, "_old"), narrow(new, "_new")


def transitioned(cohort: DataFrame) -> DataFrame:
    """Cohort rows that became not new and stayed forecasted."""
    return cohort.filter(F.col("transition") == policy.TO_RANKED)


# ---- totals of whole runs -------------------------------------------------------------------


def _tagged(old: DataFrame, new: DataFrame, *columns: str) -> DataFrame:
    return (
        old.select(*columns)
        .withColumn("run", F.lit("old"))
        .unionByName(new.select(*columns).withColumn("run", F.lit("new")))
    )


def _in(run: str) -> Column:
    return F.col("run") == run


def _share(part: Column, whole: Column) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)) * 100.0, 1)


def _bucket_counts() -> list[Column]:
    return [
        F.count_if(_in("old")).alias("old_rows"),
        F.count_if(_in("new")).alias("new_rows"),
        F.count_if(_in("old") & _new_forecasted()).alias("old_new_forecasted"),
        F.count_if(_in("new") & _new_forecasted()).alias("new_new_forecasted"),
    ]


def _bucket_changes() -> dict[str, Column]:
    net = F.col("new_new_forecasted") - F.col("old_new_forecasted")
    return {
        "net_rows": F.col("new_rows") - F.col("old_rows"),
        "net_new_forecasted": net,
        "pct_new_forecasted": _share(net, F.col("old_new_forecasted")),
    }


def bucket_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sizes of both runs and of their new and forecasted rows, as one row."""
    runs = _tagged(old, new, "sku_status", "is_forecasted")
    return runs.agg(*_bucket_counts()).withColumns(_bucket_changes())


def _tier_totals() -> list[Column]:
    tier = F.col("new_proposed_velocity")
    return [F.count_if(_in(run) & (tier == t)).alias(f"{run}_{t}") for run in ("old", "new") for t in TIERS]


def tier_dist(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows per tier in both runs, zeros included, and over all rows."""
    runs = _tagged(old, new, "new_proposed_velocity")
    totals = runs.agg(
        *_tier_totals(),
        F.count_if(_in("old")).alias("old_Total"),
        F.count_if(_in("new")).alias("new_Total"),
    )
    return _lines(
        totals,
        [
            {
                "velocity": F.lit(t),
                "old_count": F.col(f"old_{t}"),
                "new_count": F.col(f"new_{t}"),
            }
            for t in (*TIERS, "Total")
        ],
    )


def _lines(one_row: DataFrame, lines: list[dict[str, Column]]) -> DataFrame:
    """A one-row frame of totals as the given report lines."""
    structs = [F.struct(*[c.alias(name) for name, c in line.items()]) for line in lines]
    return one_row.select(F.inline(F.array(*structs)))


def reason_dist(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows per reason in both runs, for every reason of either."""
    return (
        _tagged(old, new, "velocity_reason")
        .filter(F.col("velocity_reason").isNotNull())
        .groupBy("velocity_reason")
        .agg(
            F.count_if(_in("old")).alias("old_count"),
            F.count_if(_in("new")).alias("new_count"),
        )
    )


# ---- totals of the cohort -------------------------------------------------------------------


def transition_breakdown(cohort: DataFrame) -> DataFrame:
    """Rows and share per transition that occurs."""
    filled = transition_summary(cohort)
    return filled.filter(F.col("record_count") > 0)


def _transition_counts() -> list[Column]:
    return [F.count_if(F.col("transition") == name).alias(f"t{i}") for i, name in enumerate(policy.TRANSITIONS)]


def transition_summary(cohort: DataFrame) -> DataFrame:
    """Rows and share per transition, zeros included."""
    totals = cohort.agg(F.count(F.lit(1)).alias("all_rows"), *_transition_counts())
    labels = {f"t{i}": name for i, name in enumerate(policy.TRANSITIONS)}
    return _shares(totals, labels, "transition", "record_count")


def _shares(totals: DataFrame, labels: dict[str, str], name: str, count: str) -> DataFrame:
    """One line per label of a one-row frame of counts, with its share of ``all_rows``."""
    return _lines(
        totals,
        [
            {
                name: F.lit(label),
                count: F.col(column),
                "pct_of_total": F.coalesce(
                    _share(F.col(column), F.col("all_rows")), F.lit(0.0)
                ),
            }
            for column, label in labels.items()
        ],
    )


def new_tier_dist(moved: DataFrame) -> DataFrame:
    """Rows and share of the transitioned rows per new tier, zeros included."""
    tier = F.col("new_proposed_velocity_new")
    totals = moved.agg(
        F.count(F.lit(1)).alias("all_rows"), *[F.count_if(tier == t).alias(t) for t in TIERS]
    )
    return _shares(totals, {t: t for t in TIERS}, "velocity", "record_count")


STOCK = {
    "old_proposed_ss": "proposed_safety_stock_old",
    "new_proposed_ss": "proposed_safety_stock_new",
    "old_ss_change_dollars": "safety_stock_change_dollars_old",
    "new_ss_change_dollars": "safety_stock_change_dollars_new",
}


def _stock_totals(where: Column | None = None) -> list[Column]:
    """Rounded totals of the stock columns, of the rows that meet the condition."""
    taken = lambda c: F.col(c) if where is None else F.when(where, F.col(c))
    return [F.round(F.coalesce(F.sum(taken(c)), F.lit(0.0)), 2).alias(name) for name, c in STOCK.items()]


def _stock_delta() -> Column:
    return F.round(F.col("new_proposed_ss") - F.col("old_proposed_ss"), 2)


def ss_impact(moved: DataFrame) -> DataFrame:
    """Proposed stock and stock-change dollars of the transitioned rows, as one row."""
    return moved.agg(*_stock_totals()).withColumn("ss_delta", _stock_delta())


def exec_summary(old: DataFrame, new: DataFrame, cohort: DataFrame) -> DataFrame:
    """All totals as (section, metric, value, detail) rows, numbers kept as numbers.

    One aggregate over both runs gives their sizes, buckets and tiers, and one over
    the cohort its transitions, new tiers and stock. The reasons, whose number is open, are
    grouped in a second pass over the runs.
    """
    none = F.lit(None).cast("double")

    def line(section: str, metric: str, value: Column, detail: Column = none) -> dict[str, Column]:
        return {"section": F.lit(section), "metric": F.lit(metric), "value": value.cast("double"), "detail": detail.cast("double")}

    def share(part: str, whole: str) -> Column:
        return F.coalesce(_share(F.col(part), F.col(whole)), F.lit(0.0))

    runs = _tagged(old, new, "sku_status", "is_forecasted", "new_proposed_velocity")
    sizes = runs.agg(*_bucket_counts(), *_tier_totals()).withColumns(_bucket_changes())
    tiers = [(t, F.col(f"old_{t}"), F.col(f"new_{t}")) for t in TIERS]
    of_runs = [
        *[line("Universe Overview", c, F.col(c)) for c in ("old_rows", "new_rows", "net_rows")],
        *[line("New+Forecasted Bucket Shift", c, F.col(c)) for c in ("old_new_forecasted", "new_new_forecasted")],
        line("New+Forecasted Bucket Shift", "net_new_forecasted", F.col("net_new_forecasted"), F.col("pct_new_forecasted")),
        *[line("Full Velocity Distribution Comparison", t, a, b) for t, a, b in (*tiers, ("Total", F.col("old_rows"), F.col("new_rows")))],
    ]
    moved = F.coalesce(F.col("transition") == policy.TO_RANKED, F.lit(False))
    totals = cohort.agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(moved).alias("moved_rows"),
        *_transition_counts(),
        *[F.count_if(moved & (F.col("new_proposed_velocity_new") == t)).alias(f"moved_{t}") for t in TIERS],
        *_stock_totals(moved),
    ).withColumn("ss_delta", _stock_delta())
    of_cohort = [
        *[line("Transition Breakdown", name, F.col(f"t{i}"), share(f"t{i}", "all_rows")) for i, name in enumerate(policy.TRANSITIONS)],
        *[line("Velocity Assignments for Transitioned Records", t, F.col(f"moved_{t}"), share(f"moved_{t}", "moved_rows")) for t in TIERS],
        *[line("Safety Stock Impact", c, F.col(c)) for c in (*STOCK, "ss_delta")],
    ]
    reasons = reason_dist(old, new).select(
        F.lit("Velocity Reason Distribution Comparison").alias("section"),
        F.col("velocity_reason").alias("metric"),
        F.col("old_count").cast("double").alias("value"),
        F.col("new_count").cast("double").alias("detail"),
    )
    return _lines(sizes, of_runs).unionByName(_lines(totals, of_cohort)).unionByName(reasons)


# ---- detail and its summaries ---------------------------------------------------------------


def transition_detail(moved: DataFrame) -> DataFrame:
    """Transitioned rows side by side; shared attributes come from the old run, cost from the new."""
    delta = F.col("proposed_safety_stock_new") - F.col("proposed_safety_stock_old")
    return moved.select(
        *[F.col(source).alias(name) for name, source in DETAIL.items()],
        F.concat(
            "new_proposed_velocity_old", F.lit(" -> "), "new_proposed_velocity_new"
        ).alias("VELOCITY_SHIFT"),
        F.round(delta, 2).alias("SS_CHANGE_DELTA"),
    )


def _tier_counts(column: str, prefix: str = "now_") -> list[Column]:
    return [F.count_if(F.col(column) == t).alias(f"{prefix}{t.lower()}") for t in TIERS]


def shift_matrix(moved: DataFrame) -> DataFrame:
    """Old by new tier counts, five by five with zeros, and totals of rows and columns."""
    old, new = F.col("new_proposed_velocity_old"), F.col("new_proposed_velocity_new")
    cells = moved.filter(old.isin(*TIERS) & new.isin(*TIERS)).agg(
        *[
            F.count_if((old == a) & (new == b)).alias(f"{a}{b}")
            for a in TIERS
            for b in TIERS
        ]
    )

    def line(label: str, olds: tuple[str, ...]) -> dict[str, Column]:
        counts = {b: reduce(lambda x, y: x + y, [F.col(f"{a}{b}") for a in olds]) for b in TIERS}
        return {
            "old_proposed": F.lit(label),
            **{f"new_{b.lower()}": counts[b] for b in TIERS},
            "total": reduce(lambda x, y: x + y, counts.values()),
        }

    return _lines(cells, [*[line(t, (t,)) for t in TIERS], line("Total", TIERS)])


def dc_summary(moved: DataFrame) -> DataFrame:
    """Transitioned rows, new tiers and stock delta by the new run's dc."""

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0.0))

    delta = total("proposed_safety_stock_new") - total("proposed_safety_stock_old")
    return (
        moved.filter(F.col("dc_new").isNotNull())
        .groupBy(F.col("dc_new").alias("dc"))
        .agg(
            F.count(F.lit(1)).alias("records_transitioned"),
            *_tier_counts("new_proposed_velocity_new"),
            F.round(delta, 2).alias("ss_delta_units"),
        )
    )


def mcat_summary(moved: DataFrame) -> DataFrame:
    """Transitioned rows and new tiers by the new run's category."""
    return (
        moved.filter(F.col("mcat_new").isNotNull())
        .groupBy(F.col("mcat_new").alias("mcat"))
        .agg(
            F.count(F.lit(1)).alias("records_transitioned"),
            *_tier_counts("new_proposed_velocity_new"),
        )
    )


def sorted_summary(summary: DataFrame) -> DataFrame:
    """Report order: most transitioned rows first."""
    return summary.orderBy(F.desc("records_transitioned"))


# ---- pivots over the detail -----------------------------------------------------------------


def _tier_pivot(detail: DataFrame, row: str) -> DataFrame:
    return (
        detail.groupBy(row)
        .pivot("NEW_PROPOSED_VELOCITY", list(TIERS))
        .agg(F.count("JDA_ITEM"))
        .fillna(0, list(TIERS))
    )


def pivot_shift(detail: DataFrame) -> DataFrame:
    return _tier_pivot(detail, "OLD_PROPOSED_VELOCITY")


def pivot_dc(detail: DataFrame) -> DataFrame:
    return _tier_pivot(detail, "DC_NEW")


def pivot_mcat(detail: DataFrame) -> DataFrame:
    return _tier_pivot(detail, "MCAT")


def pivot_reason(detail: DataFrame) -> DataFrame:
    return _tier_pivot(detail, "NEW_VELOCITY_REASON")


def _stock_pivot(detail: DataFrame, row: str) -> DataFrame:
    return detail.groupBy(row).agg(
        F.round(F.sum("OLD_PROPOSED_SS"), 2).alias("sum_old_ss"),
        F.round(F.sum("NEW_PROPOSED_SS"), 2).alias("sum_new_ss"),
        F.round(F.sum("SS_CHANGE_DELTA"), 2).alias("sum_ss_delta"),
    )


def pivot_ss_dc(detail: DataFrame) -> DataFrame:
    return _stock_pivot(detail, "DC_NEW")


def pivot_ss_mcat(detail: DataFrame) -> DataFrame:
    return _stock_pivot(detail, "MCAT")
