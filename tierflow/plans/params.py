"""Run parameters."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from tierflow.plans import policy

STATUS_MODES = ("no_receipt", "coalesced", "recent")


@dataclass(frozen=True)
class TierParams:
    """One run. ``as_of`` stands for today; no operator reads the clock."""

    as_of: dt.date
    fiscal_year: str
    forecast_weeks: int = 13
    weight_dollars: float = 0.45
    weight_units: float = 0.55
    cutoff_a: float = 0.10
    cutoff_b: float = 0.30
    cutoff_c: float = 0.60
    cutoff_d: float = 1.00
    recent_weeks: int = 13
    projection_weeks: int = 13
    snapshot_weeks: int = 8
    line_price_days: int = 730
    sales_price_days: int = 1095

    @property
    def cutoffs(self) -> tuple[tuple[float, str], ...]:
        return (
            (self.cutoff_a, "A"),
            (self.cutoff_b, "B"),
            (self.cutoff_c, "C"),
            (self.cutoff_d, "D"),
        )


@dataclass(frozen=True)
class NetworkPolicy:
    """Who the network is and what it leaves out.

    ``network`` is the code that the plant, in-stock and category tables carry
    for this network; set it to your own.
    """

    network: str
    status_mode: str
    excluded_plants: tuple[str, ...] = policy.EXCLUDED_PLANTS
    excluded_plant_prefix: str = policy.EXCLUDED_PLANT_PREFIX
    excluded_vendors: tuple[str, ...] = policy.EXCLUDED_VENDORS
    excluded_item_type: str = policy.EXCLUDED_ITEM_TYPE
    excluded_category_keys: tuple[str, ...] = policy.EXCLUDED_CATEGORY_KEYS
    excluded_product_keys: tuple[str, ...] = policy.EXCLUDED_PRODUCT_KEYS
    excluded_warehouses: tuple[str, ...] = policy.EXCLUDED_WAREHOUSES
    vendor_managed_regions: tuple[str, ...] = policy.VENDOR_MANAGED_REGIONS
    high_cube_categories: tuple[str, ...] = policy.HIGH_CUBE_CATEGORIES
    location_range: tuple[int, int] = policy.LOCATION_RANGE
    item_overrides: tuple[tuple[str, str, str], ...] = field(default=policy.ITEM_OVERRIDES)

    def __post_init__(self) -> None:
        if self.status_mode not in STATUS_MODES:
            raise ValueError(f"status_mode {self.status_mode!r} is not one of {STATUS_MODES}")


def material_network(network: str = "N1", status_mode: str = "coalesced", **over) -> NetworkPolicy:
    return NetworkPolicy(network=network, status_mode=status_mode, **over)


def usn_network(network: str = "N2", status_mode: str = "recent", **over) -> NetworkPolicy:
    return NetworkPolicy(network=network, status_mode=status_mode, **over)
