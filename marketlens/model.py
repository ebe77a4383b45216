"""Data model: the six marketplace tables, KPI parameters and the drill-down filter."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Marketplace:
    """The six tables, by name. Raw before ``clean``, clean after it. ``cube``, where it is stored, holds the orders
    summed up by the dimensions they can be filtered by (``operators.cube``)."""

    users: DataFrame
    restaurants: DataFrame
    riders: DataFrame
    orders: DataFrame
    events: DataFrame
    nps: DataFrame
    cube: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> "Marketplace":
        """Other tables for some; a cube is kept only where the orders it sums up stay."""
        if "orders" in tables:
            tables.setdefault("cube", None)
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_NAMES}


TABLE_NAMES = ("users", "restaurants", "riders", "orders", "events", "nps")


# Fixed values that must equal the reference's for the same results.
ASSUMED_MONTHLY_MARKETING_SPEND = 50_000
ASSUMED_CUSTOMER_LIFESPAN_YEARS = 2.0
DEFAULT_SPLIT_DATE = dt.date(2025, 7, 1)
FUNNEL_STAGES = ["app_open", "menu_view", "add_to_cart", "checkout_started", "payment_completed"]
AGE_ORDER = ["18-24", "25-34", "35-44", "45-54", "55+", "Unknown"]
AB_GROUPS = ("Control", "Treatment")
ORDER_FLAG_COLUMNS = ["complaint_flag", "wrong_item_flag", "is_promo_used", "is_scheduled_order"]
ORDER_TIME_COLUMNS = ["order_placed_time", "order_accepted_time", "promised_delivery_time",
                      "ready_time", "pickup_time", "delivered_time"]
DEMOGRAPHIC_COLUMNS = ["gender", "profession", "income_bracket"]
UNKNOWN = "Unknown"
DELIVERED = "Delivered"
CANCELLED = "Cancelled"
# age bands: (upper bound, exclusive; label), then the label for everything else (null age included)
AGE_BANDS = [(25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54")]
AGE_LAST_BAND = "55+"
IQR_MULTIPLIER = 1.5  # upper fence = q3 + 1.5 * (q3 - q1), with q1, q3 the "nearest" 25 % and 75 % quantiles
RFM_MAX_BINS = 5
# RFM segments, first match wins, on fractions (score - 1) / (bins - 1) of the R and F scores
SEGMENT_RULES = [
    # label, least and most R fraction, least and most F fraction
    ("Champions", 0.75, 1.0, 0.75, 1.0),
    ("New / Promising", 0.75, 1.0, 0.0, 0.25),
    ("At Risk (was loyal)", 0.0, 0.25, 0.75, 1.0),
    ("Lost / Hibernating", 0.0, 0.25, 0.0, 0.25),
]
OTHER_SEGMENT = "Regular"


@dataclass(frozen=True)
class KpiConfig:
    """Parameters the reference hard-codes; defaults equal its constants."""

    monthly_marketing_spend: float = ASSUMED_MONTHLY_MARKETING_SPEND
    lifespan_years: float = ASSUMED_CUSTOMER_LIFESPAN_YEARS
    split_date: dt.date = DEFAULT_SPLIT_DATE
    week_key: str = "reference"  # "reference" = calendar year + ISO week, "iso" = ISO year + ISO week
    ltv_delivered_only: bool = False
    significance: float = 0.05


@dataclass(frozen=True)
class FilterSpec:
    """Drill-down selection; an empty list or None means "no filter" on that dimension."""

    date_range: tuple[dt.date, dt.date] | None = None
    cities: list[str] = field(default_factory=list)
    cuisines: list[str] = field(default_factory=list)
    channels: list[str] = field(default_factory=list)
    devices: list[str] = field(default_factory=list)
    ab_groups: list[str] = field(default_factory=list)
    genders: list[str] = field(default_factory=list)
    professions: list[str] = field(default_factory=list)
    income_brackets: list[str] = field(default_factory=list)
    age_groups: list[str] = field(default_factory=list)

    @property
    def user_filters(self) -> dict[str, list[str]]:
        return {"acquisition_channel": self.channels, "gender": self.genders, "profession": self.professions,
                "income_bracket": self.income_brackets, "age_group": self.age_groups}

    @property
    def order_filters(self) -> dict[str, list[str]]:
        return {"city": self.cities, "device_type": self.devices, "ab_test_group": self.ab_groups}

    def any_list(self) -> bool:
        return any([self.cities, self.cuisines, self.channels, self.devices, self.ab_groups, self.genders,
                    self.professions, self.income_brackets, self.age_groups])
