"""Forecast attach, weights, ranking and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierflow.operators.joins import lookup_join
from tierflow.plans import policy
from tierflow.plans.params import TierParams
from tierflow.sources.registry import stage

RANK_KEYS = ("dc", "mcat")

# columns of the active universe, which the tiering keeps
BASE_COLUMNS = (
    "is_forecasted",
    "network",
    "dc",
    "location",
    "mcat",
    "item",
    "sku",
    "material_id",
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
    "total_forecasted_qty",
    "system_velocity",
    "is_active",
    "is_filtered_out",
    "first_receipt_flg",
)


def attach_forecast(
    universe: DataFrame,
    forecast: DataFrame,
    plant: DataFrame | None = None,
    location: str = "location",
    unique: bool = False,
) -> DataFrame:
    """Active, kept rows of the universe with their forecast quantity, distinct.

    ``plant`` gives the location of rows that have none of their own; leave it
    out where the universe always has a location and an item. The join then needs
    no care for null keys, and the distinct shares its shuffle. ``location`` may then name a
    column of equal values by which the rows lie already. Lists that the universe
    carries for the stock operators are kept; a universe that carries its rows' forecast has it
    there and needs no join. ``unique`` says that the rows and the forecast's
    keys are distinct already; no row is grouped then.
    """
    lists = [c for c in policy.CARRIED_LISTS if c in universe.columns]
    rows = universe.filter(F.col("is_active") & ~F.col("is_filtered_out"))
    matched = forecast.select(
        "location", "item", "total_forecasted_qty", F.lit(True).alias("has_forecast")
    )
    if plant is None:
        rows = rows.join(matched.withColumnRenamed("location", location), ["item", location], "left")
    else:
        fallback = plant.select(
            F.col("plant_id").alias("dc"), F.col("network_plant_id").alias("plant_location")
        )
        rows = rows.join(fallback, "dc", "left").withColumn(
            "location", F.coalesce("location", "plant_location")
        )
        if policy.CARRIED_FORECAST in universe.columns:
            own = F.col(policy.CARRIED_FORECAST)
            rows = rows.select("*", own["total_forecasted_qty"].alias("total_forecasted_qty"), own.isNotNull().alias("has_forecast"))
        else:
            rows = lookup_join(rows, [matched], ("location", "item"))
    rows = (
        rows.withColumn(
            "is_forecasted",
            F.when(F.col("has_forecast"), "Forecasted").otherwise("Not Forecasted"),
        )
        .withColumn("total_forecasted_qty", F.coalesce("total_forecasted_qty", F.lit(0.0)))
        .select(*BASE_COLUMNS, *lists)
    )
    return rows if unique else rows.distinct()


def weekly_metrics(df: DataFrame, weeks: int = 13) -> DataFrame:
    """Weekly average quantity, forecast dollars and the sku label."""
    qty, dollars = F.col("total_forecasted_qty"), F.col("total_forecasted_qty") * F.col("cogs")
    return df.withColumns(
        {
            "sku": F.coalesce("material_id", "usn"),
            "weekly_average_forecasted_qty": qty / weeks,
            "total_forecasted_dollars": F.round(dollars, 2),
            "weekly_average_forecasted_dollars": F.round(dollars / weeks, 2),
        }
    )


def velocity_weight(
    df: DataFrame, weeks: int = 13, weight_dollars: float = 0.45, weight_units: float = 0.55
) -> DataFrame:
    """Weighted weekly dollars and units, the value that ranks an item."""
    qty = F.coalesce("total_forecasted_qty", F.lit(0.0))
    return df.withColumn(
        "velocity_weight",
        F.lit(weight_dollars) * (qty * F.col("cogs") / weeks) + F.lit(weight_units) * (qty / weeks),
    )


def is_ranked() -> Column:
    """Forecasted, and not new or else superseding an older item."""
    status, forecasted = F.col("sku_status"), F.col("is_forecasted") == "Forecasted"
    superseded = F.col("superseded_sku") == "superseded"
    return forecasted & (status.isNull() | (status != "New") | superseded)


def weight_ranks(
    df: DataFrame, keys: tuple[str, ...] = RANK_KEYS, weight: str = "velocity_weight"
) -> DataFrame:
    """Percentile of every distinct weight in its group, exact, without a whole-group sort.

    A plain percent_rank sorts each (dc, mcat) in one task. Here equal weights are counted
    first, so that copies shrink to one row before the shuffle. The distinct (group,
    weight) rows are dealt out by range, and each range is a bucket, written with its
    number: ranges come from the data, so weights that lie close together spread over as many
    tasks as others. The rows above a weight are those of the group's higher buckets, summed
    over at most one row per bucket, plus those above it in its own bucket. A null weight
    ranks first.

    The group is one struct, so that a null key is a group like any other.
    """
    distinct = df.groupBy(F.struct(*keys).alias("rank_group"), weight).agg(F.count(F.lit(1)).alias("n"))
    ranges = distinct.repartitionByRange("rank_group", F.col(weight).desc_nulls_first())
    # ranges are drawn anew in each run, so both readers below need the written ones
    weights = stage(ranges.withColumn("bucket", F.spark_partition_id()), "ranked-weights")
    whole = Window.partitionBy("rank_group")
    higher = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        weights.groupBy("rank_group", "bucket")
        .agg(F.sum("n").alias("bucket_rows"))
        .select(
            "rank_group",
            "bucket",
            F.coalesce(F.sum("bucket_rows").over(higher), F.lit(0)).alias("rows_in_higher_buckets"),
            F.sum("bucket_rows").over(whole).alias("group_rows"),
        )
    )
    inside = (
        Window.partitionBy("rank_group", "bucket")
        .orderBy(F.desc_nulls_first(weight))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    above = F.col("rows_in_higher_buckets") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    percentile = F.when(F.col("group_rows") <= 1, F.lit(0.0)).otherwise(
        F.round(above / (F.col("group_rows") - 1), 3)
    )
    return weights.join(buckets, ["rank_group", "bucket"]).select(
        *[F.col(f"rank_group.{k}").alias(k) for k in keys],
        weight,
        percentile.alias("calculated_velocity_percentile"),
    )


def tier_percentile(
    df: DataFrame, keys: tuple[str, ...] = RANK_KEYS, weight: str = "velocity_weight"
) -> DataFrame:
    """Rows with their rounded percent rank by weight, highest first, within the group.

    ``df`` feeds the counts and the join, so hand in a staged table or a frame
    that ends in a shuffle; Spark then reuses that shuffle. The join is on the
    weight too, so a large group spreads over many tasks, and adaptive execution
    splits the rows of a single crowded weight.
    """
    key = F.struct(*keys, weight).alias("rank_key")
    ranks = weight_ranks(df, keys, weight).select(key, "calculated_velocity_percentile")
    return df.withColumn("rank_key", key).join(ranks, "rank_key", "left").drop("rank_key")


def tier(params: TierParams) -> Column:
    """Tier of a ranked row by the first cutoff its rounded percentile does not pass."""
    percentile = F.col("calculated_velocity_percentile")
    out = F.when(F.col("cogs").isNull(), policy.MISSING_TIER)
    for cutoff, name in params.cutoffs:
        out = out.when(percentile <= cutoff, name)
    return out


def ranked_tiers(df: DataFrame, params: TierParams) -> DataFrame:
    """Group 1: ranked rows, tiers A to D by percentile."""
    rows = weekly_metrics(df.filter(is_ranked()), params.forecast_weeks)
    rows = velocity_weight(
        rows, params.forecast_weeks, params.weight_dollars, params.weight_units
    )
    return tier_percentile(rows).withColumn("new_proposed_velocity", tier(params))


def _unranked(df: DataFrame, params: TierParams) -> DataFrame:
    """Rows outside the ranking: C when new, E when neither new nor forecasted."""
    new, old = F.col("sku_status") == "New", F.col("sku_status") == "Not New"
    unforecasted = F.col("is_forecasted") == "Not Forecasted"
    return weekly_metrics(df, params.forecast_weeks).withColumns(
        {
            "velocity_weight": F.lit(None).cast("double"),
            "calculated_velocity_percentile": F.lit(None).cast("double"),
            "new_proposed_velocity": F.when(new, "C").when(unforecasted & old, "E"),
        }
    )


def forced_c(df: DataFrame, params: TierParams) -> DataFrame:
    """Group 2: forecasted, new and not superseded rows go to C unranked."""
    return _unranked(
        df.filter(
            (F.col("is_forecasted") == "Forecasted")
            & (F.col("sku_status") == "New")
            & (F.col("superseded_sku") == "not superseded")
        ),
        params,
    )


def unforecast_tier(df: DataFrame, params: TierParams) -> DataFrame:
    """Group 3: rows without a forecast are C when new and E when not."""
    return _unranked(df.filter(F.col("is_forecasted") == "Not Forecasted"), params)


def classify(df: DataFrame, params: TierParams) -> DataFrame:
    """All three groups. Only the ranked rows take part in the ranking shuffle.

    The flags are never null, so groups 2 and 3 together are the rows that are
    not ranked, and one pass gives both their tiers.
    """
    return ranked_tiers(df, params).unionByName(_unranked(df.filter(~is_ranked()), params))
