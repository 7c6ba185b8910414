"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.anchors import date_lit
from tidemark.functions.fixed import ACTIVE, ACTIVE_LIKE, NAVIGATION_EVENTS

# Account attributes carried by most views, and the dashboard slice.
ATTRS = ["industry", "segment", "hq_country"]
SLICE = ["product_sk", *ATTRS]


def open_at(d: date | None) -> Column:
    """`end_date IS NULL OR end_date >= d`."""
    return F.col("end_date").isNull() | (F.col("end_date") >= date_lit(d))


def live_at(start_by: date | None, open_from: date | None, status: str = ACTIVE) -> Column:
    """Subscription of `status`, started on or before `start_by` and not ended
    before `open_from` (the MRR snapshot rule)."""
    return ((F.col("status") == status)
            & (F.col("start_date") <= date_lit(start_by))
            & open_at(open_from))


def is_active_status() -> Column:
    """`status LIKE '%Active%'` as a non-null flag (NULL status -> false)."""
    return F.coalesce(F.col("status").like(ACTIVE_LIKE), F.lit(False))


def not_navigation() -> Column:
    """`event_type NOT IN ('login','logout','page_view')`; NULL type is dropped."""
    return ~F.col("event_type").isin(*NAVIGATION_EVENTS)


def ratio(num: Column, den: Column) -> Column:
    """num::float8 / NULLIF(den, 0)::float8."""
    return num.cast("double") / F.nullif(den, F.lit(0)).cast("double")
