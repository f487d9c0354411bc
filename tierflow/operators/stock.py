"""Coverage weeks, safety stock and change class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierflow.operators.dims import high_cube, import_flag
from tierflow.operators.joins import lookup_join
from tierflow.plans import policy


def coverage_weeks(tier: str) -> Column:
    """Weeks of cover by import flag, cube and the tier in the given column, else 0."""
    weeks = F.create_map(
        *[
            F.lit(entry)
            for (flag, cube), row in policy.COVERAGE_WEEKS.items()
            for name, number in zip(policy.TIERS, row)
            for entry in (f"{flag}|{cube}|{name}", number)
        ]
    )
    key = F.concat_ws("|", "import_flag", "cube", tier)
    return F.coalesce(F.try_element_at(weeks, key), F.lit(0))


def flags_by_item(
    item_master: DataFrame, categories: tuple[str, ...] = policy.HIGH_CUBE_CATEGORIES
) -> DataFrame:
    """One row per item with the list of its flags, one entry for each row that a lookup gives."""
    flags = import_flag(item_master)
    bulky = high_cube(item_master, categories).select("item", "pcat", "high_cube_flg")
    entries = F.collect_list(F.struct("import_flag", "pcat", "high_cube_flg"))
    return flags.join(bulky, "item", "left").groupBy("item").agg(F.sort_array(entries).alias(policy.FLAG_LIST))


def orders_by_place(plant: DataFrame, projections: DataFrame) -> DataFrame:
    """One row per (item, dc) with the list of projected orders of the dc's plants."""
    locations = _order_plants(plant).distinct()
    entries = F.collect_list(F.struct("soq_plant", "soq_qty"))
    placed = _orders(projections).join(locations, "soq_plant")
    return placed.groupBy("item", "dc").agg(F.sort_array(entries).alias(policy.ORDER_LIST))


def _order_plants(plant: DataFrame) -> DataFrame:
    return plant.select(F.col("plant_id").alias("dc"), F.col("network_plant_id").alias("soq_plant"))


def _orders(projections: DataFrame) -> DataFrame:
    return projections.select(
        F.col("plant").alias("soq_plant"), "item", F.col("total_soq").alias("soq_qty")
    )


def _unfolded(df: DataFrame, name: str, entries: Column) -> DataFrame:
    """The rows once for each entry of a list of structs, once with nulls where it has none."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.inline_outer(entries))


def sscov(
    df: DataFrame,
    item_master: DataFrame,
    categories: tuple[str, ...] = policy.HIGH_CUBE_CATEGORIES,
) -> DataFrame:
    """Coverage weeks under the system tier and under the proposed tier.

    Rows that carry the list of ``flags_by_item`` have their flags in it and need no shuffle.
    """
    if policy.FLAG_LIST in df.columns:
        flagged = _unfolded(df, policy.FLAG_LIST, F.col(policy.FLAG_LIST))
    else:
        flags = import_flag(item_master)
        bulky = high_cube(item_master, categories).select("item", "pcat", "high_cube_flg")
        flagged = lookup_join(df, [flags, bulky], ("item",))
    return (
        flagged.withColumn("cube", F.when(F.col("high_cube_flg") == "Y", "High").otherwise("Low"))
        .withColumns(
            {
                "current_sscov": coverage_weeks("system_velocity"),
                "proposed_sscov": coverage_weeks("new_proposed_velocity"),
            }
        )
        .drop("high_cube_flg")
    )


def safety_stock(df: DataFrame, plant: DataFrame, projections: DataFrame) -> DataFrame:
    """Stock under both coverages, its change in units and dollars, and projected orders.

    Rows that carry the list of ``orders_by_place`` have their orders in it and need no shuffle.
    """
    average = F.col("weekly_average_forecasted_qty")
    change = average * (F.col("proposed_sscov") - F.col("current_sscov"))
    placed = df.join(_order_plants(plant), "dc", "left")
    if policy.ORDER_LIST in df.columns:
        own = F.filter(policy.ORDER_LIST, lambda o: o["soq_plant"] == F.col("soq_plant"))
        entries = F.transform(own, lambda o: F.struct(o["soq_qty"].alias("soq_qty")))
        ordered = _unfolded(placed, policy.ORDER_LIST, entries)
    else:
        ordered = lookup_join(placed, [_orders(projections)], ("soq_plant", "item"))
    return (
        ordered.withColumns(
            {
                "current_total_soq_13_weeks": F.coalesce("soq_qty", F.lit(0.0)),
                "current_safety_stock": F.round(average * F.col("current_sscov"), 2),
                "proposed_safety_stock": F.round(average * F.col("proposed_sscov"), 2),
                "safety_stock_change": F.round(change, 2),
                "safety_stock_change_dollars": F.round(change * F.col("cogs"), 2),
                "velocity_change_class": change_class("system_velocity", "new_proposed_velocity"),
            }
        )
        .drop("soq_plant", "soq_qty")
    )


def change_class(system: str, proposed: str) -> Column:
    """Match, Demotion or Promotion by letter order; Unclassified when either is missing."""
    old, new = F.col(system), F.col(proposed)
    return (
        F.when(old.isNull() | new.isNull(), "Unclassified")
        .when(old == new, "Match")
        .when(old < new, "Demotion")
        .otherwise("Promotion")
    )
