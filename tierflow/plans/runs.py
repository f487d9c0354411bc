"""Whole runs, composed of the operators."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.operators import audit, dims, impact, output, stock
from tierflow.operators.classify import attach_forecast, classify
from tierflow.operators.universe import universe_material, universe_usn, with_receipts
from tierflow.plans.params import NetworkPolicy, TierParams
from tierflow.sources.registry import stage
from tierflow.sources.uploads import as_upload


def active_universe(
    tables: Mapping[str, DataFrame],
    params: TierParams,
    net: NetworkPolicy,
    kind: str,
    item_list: DataFrame | None = None,
    place_list: DataFrame | None = None,
) -> DataFrame:
    """Active rows of the network with their forecast: the input of the tiering.

    They may carry lists, see ``universe_material``.
    """
    forecast = dims.forecast_window(
        tables["forecast"], tables["plant"], net.network, params.as_of, params.forecast_weeks
    )
    if kind == "material":
        # the location of a material row is its dc, so there is nothing to fall back on
        universe = universe_material(tables, params, net, True, item_list, place_list)
        return attach_forecast(universe, forecast, location="dc")
    if kind == "usn":
        universe = universe_usn(tables, params, net, True, item_list, place_list, forecast)
        return attach_forecast(universe, forecast, tables["plant"])
    raise ValueError(f"kind {kind!r} is not 'material' or 'usn'")


def dated_universe(
    tables: Mapping[str, DataFrame], params: TierParams, net: NetworkPolicy
) -> DataFrame:
    """Active rows of the material network with their forecast, for every status rule.

    ``with_receipts`` gives the rows of one rule, those of ``active_universe`` with the lists of
    the stock operators. The rules share all joins, so runs under several of them read this once.
    """
    forecast = dims.forecast_window(
        tables["forecast"], tables["plant"], net.network, params.as_of, params.forecast_weeks
    )
    universe = universe_material(tables, params, net, True, *stock_lists(tables, params, net), all_dates=True)
    return attach_forecast(universe, forecast, location="dc", unique=True)


def stock_lists(
    tables: Mapping[str, DataFrame], params: TierParams, net: NetworkPolicy
) -> tuple[DataFrame, DataFrame]:
    """The lookups of the stock operators as lists: by item, and by item and dc."""
    projections = dims.soq_first_weeks(tables["soq"], params.fiscal_year, params.projection_weeks)
    return (
        stock.flags_by_item(tables["item_master"], net.high_cube_categories),
        stock.orders_by_place(tables["plant"], projections),
    )


def reclassify(
    tables: Mapping[str, DataFrame],
    params: TierParams,
    net: NetworkPolicy,
    kind: str,
    dated: DataFrame | None = None,
) -> DataFrame:
    """Analysis table of one network.

    The active universe has several readers (rank counts, ranked rows and the
    two unranked groups) and is staged as a table where the cluster names a folder.
    ``dated`` is a staged ``dated_universe`` of the material network that other runs read as well.
    It carries the lookups of the stock operators as lists; unfolded after the ranking, they
    give the rows that the lookups would, and the wide rows are not shuffled again.
    """
    projections = dims.soq_first_weeks(
        tables["soq"], params.fiscal_year, params.projection_weeks
    )
    if kind == "material":
        if dated is None:
            dated = stage(dated_universe(tables, params, net), "dated-universe")
        base = with_receipts(dated, params, net)
    else:
        lists = stock_lists(tables, params, net)
        base = stage(active_universe(tables, params, net, kind, *lists), "active-universe")
    tiers = classify(base, params)
    covered = stock.sscov(tiers, tables["item_master"], net.high_cube_categories)
    stocked = stock.safety_stock(covered, tables["plant"], projections)
    identifier = "material_id" if kind == "material" else "usn"
    return output.analysis(stocked, params.as_of, identifier)


def rule_change(
    tables: Mapping[str, DataFrame],
    params: TierParams,
    net: NetworkPolicy,
    modes: tuple[str, str] = ("no_receipt", "coalesced"),
    kind: str = "material",
) -> tuple[DataFrame, DataFrame]:
    """Analysis under an old and a new status rule, everything else the same."""
    before, after = (replace(net, status_mode=m) for m in modes)
    dated = stage(dated_universe(tables, params, net), "dated-universe") if kind == "material" else None
    return reclassify(tables, params, before, kind, dated), reclassify(tables, params, after, kind, dated)


def impact_report(old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """Result sets of the before/after report by dataset name."""
    cohort = stage(impact.cohort_of(*impact.reported(old, new)), "impact-cohort")
    moved = impact.transitioned(cohort)
    detail = impact.transition_detail(moved)
    return {
        "Executive Summary": impact.exec_summary(old, new, cohort),
        "Transitioned Detail": detail,
        "Velocity Shift Matrix": impact.shift_matrix(moved),
        "Summary by DC": impact.sorted_summary(impact.dc_summary(moved)),
        "Summary by MCAT": impact.sorted_summary(impact.mcat_summary(moved)),
        "Transition Breakdown": impact.transition_breakdown(cohort).orderBy(
            F.desc("record_count")
        ),
        "Pivot - Velocity Shift": impact.pivot_shift(detail),
        "Pivot - By DC": impact.pivot_dc(detail),
        "Pivot - By MCAT": impact.pivot_mcat(detail),
        "Pivot - SS Impact by DC": impact.pivot_ss_dc(detail),
        "Pivot - SS Impact by MCAT": impact.pivot_ss_mcat(detail),
        "Pivot - Reason x Velocity": impact.pivot_reason(detail),
    }


def audit_report(
    recommendations: DataFrame, report: DataFrame, seq: str = "seq"
) -> dict[str, DataFrame]:
    """Result sets of the application audit: summary and rows not updated."""
    status = audit.apply_status(as_upload(recommendations), audit.latest_state(report, seq))
    return {
        "summary": audit.metric_rows(audit.apply_summary(status)),
        "not_updated": audit.sorted_not_updated(audit.not_updated(status)),
    }


def validation_report(upload: DataFrame, current: DataFrame) -> dict[str, DataFrame]:
    """Result sets of the lookup validation: all rows and the counts."""
    validated = audit.validate(upload, current)
    return {
        "Velocity Validation": validated,
        "Summary": audit.validation_summary(validated),
    }


def diff_report(old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """Result sets of the diff of two uploads: changed rows in report order, and the counts."""
    before, after = as_upload(old), as_upload(new)
    return {
        "changes": audit.sorted_diff(audit.diff_uploads(before, after)),
        "summary": audit.metric_rows(audit.diff_summary(before, after)),
    }
