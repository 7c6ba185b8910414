"""Run parameters.

Wall-clock reads and hard-coded windows of the original report SQL are
parameters here; the defaults are the original's, the current date included.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime


def today() -> date:
    return date.today()


@dataclass(frozen=True)
class Params:
    # CURRENT_DATE of the original (renewal pipeline, active feature users).
    as_of: date = field(default_factory=lambda: today())
    # Renewal look-ahead in days (`CURRENT_DATE + INTERVAL '90 Days'`).
    renewal_days: int = 90
    # NRR base looks back this many months from the latest start date.
    nrr_months_back: int = 11
    # Event-depth window; both ends inclusive, compared as timestamps, so the
    # default end is midnight at the *start* of Dec 31.
    depth_start: datetime = datetime(2024, 12, 1)
    depth_end: datetime = datetime(2024, 12, 31)
    # Dashboard slicers for the KPI operators: column -> value equality filters
    # on the KPI's input view (product_sk, segment, industry, hq_country).
    slicers: dict = field(default_factory=dict)

    def __hash__(self):  # dict field: hash by value for caching
        return hash((self.as_of, self.renewal_days, self.nrr_months_back,
                     self.depth_start, self.depth_end, tuple(sorted(self.slicers.items()))))
