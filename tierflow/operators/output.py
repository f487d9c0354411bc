"""Result tables: full analysis, changes only, upload rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.plans import policy

ANALYSIS_SORT = ("network", "dc", "mcat", "new_proposed_velocity")


def service_level(tier: str) -> Column:
    """Service percentage of a tier, 99999 for any other text or null."""
    levels = F.create_map(*[F.lit(x) for pair in policy.SERVICE_LEVELS.items() for x in pair])
    return F.coalesce(
        F.try_element_at(levels, F.coalesce(F.col(tier), F.lit(""))),
        F.lit(policy.SERVICE_LEVEL_UNKNOWN),
    )


def velocity_reason() -> Column:
    """The rule that gave the row its tier."""
    forecasted = F.col("is_forecasted") == "Forecasted"
    unforecasted = F.col("is_forecasted") == "Not Forecasted"
    new, old = F.col("sku_status") == "New", F.col("sku_status") == "Not New"
    superseded = F.col("superseded_sku") == "superseded"
    fresh = F.col("superseded_sku") == "not superseded"
    return (
        F.when(forecasted & (old | (new & superseded)), policy.REASON_RANKED)
        .when(forecasted & new & fresh, policy.REASON_NEW_FORECASTED)
        .when(unforecasted & new, policy.REASON_NEW_UNFORECASTED)
        .when(unforecasted & old, policy.REASON_IDLE)
        .otherwise(policy.REASON_OTHER)
    )


def analysis(df: DataFrame, as_of: dt.date, identifier: str) -> DataFrame:
    """Final projection; ``identifier`` is material_id or usn, after the network."""
    return df.select(
        F.lit(as_of).alias("table_created_date"),
        "network",
        "dc",
        F.col("location").alias("jda_loc"),
        "mcat",
        F.col("item").alias("jda_item"),
        identifier,
        "sku_description",
        F.col("uom").alias("jda_uom"),
        "is_forecasted",
        "is_active",
        "is_filtered_out",
        "first_receipt_flg",
        "sku_status",
        "superseded_sku",
        F.col("instock_numerator").alias("instock_local_unit_numerator_8_weeks"),
        F.col("instock_denominator").alias("instock_local_unit_denominator_8_weeks"),
        F.round("instock_rate", 2).alias("current_instock_percent_8_weeks"),
        "total_forecasted_qty",
        "weekly_average_forecasted_qty",
        "total_forecasted_dollars",
        "weekly_average_forecasted_dollars",
        "velocity_weight",
        "calculated_velocity_percentile",
        "system_velocity",
        "new_proposed_velocity",
        service_level("new_proposed_velocity").alias("service_level"),
        "velocity_change_class",
        velocity_reason().alias("velocity_reason"),
        "pcat",
        "cube",
        "import_flag",
        "current_sscov",
        "proposed_sscov",
        "current_total_soq_13_weeks",
        "current_safety_stock",
        "proposed_safety_stock",
        "safety_stock_change",
        "safety_stock_change_dollars",
        F.col("retail_price").alias("sku_retail_price"),
        "cogs",
    )


def sorted_analysis(df: DataFrame) -> DataFrame:
    """Report order, for a sink that keeps it: a whole sort, so not part of the analysis."""
    return df.orderBy(
        *[F.asc_nulls_last(c) for c in ANALYSIS_SORT], F.desc_nulls_first("velocity_weight")
    )


def changes(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Rows whose proposed tier differs from the system's; no system tier, no row.

    The usn network's rows also carry the usn and the dc.
    """
    extra = ["usn", "dc"] if "usn" in df.columns else []
    return df.filter(F.col("new_proposed_velocity") != F.col("system_velocity")).select(
        F.lit(as_of).alias("table_created_date"),
        "jda_item",
        "jda_loc",
        *extra,
        F.col("new_proposed_velocity").alias("proposed_velocity"),
        F.col("new_proposed_velocity").alias("proposed_velocity_"),
        "service_level",
        F.col("system_velocity").alias("sap_velocity"),
        "velocity_reason",
    )


def upload_rows(summary: DataFrame) -> DataFrame:
    """Changes that the system takes: tiers A to E."""
    return summary.filter(F.col("proposed_velocity").isin(*policy.TIERS)).drop(
        "table_created_date"
    )
