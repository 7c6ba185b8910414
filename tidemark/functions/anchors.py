"""Anchor scalars.

The report SQL derives its windows from one-row CTEs (latest start date,
latest event, month bounds from the calendar) cross-joined into every query.
Here each anchor is one tiny aggregate job whose single value comes back to
the driver and is then used as a literal: Catalyst folds it, and range filters
on the big facts become parquet ``PushedFilters`` (row-group skipping) instead
of a nested-loop condition. Values are cached on the ``Tables`` so a batch of
views computes each anchor once.

``None`` means the anchor's input was empty; literals built from it are typed
NULLs, so dependent filters select nothing, as in SQL.
"""

from __future__ import annotations

from calendar import monthrange
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.sources.star import Tables


def _cached(t: Tables, key, compute):
    if key not in t.cache:
        t.cache[key] = compute()
    return t.cache[key]


def _greatest(t: Tables, table: str, scan):
    """MAX of the table's anchor column: from the zone map where the stored star
    has one (no data file is opened), else by ``scan``."""
    return t.zone_bounds(table)[1] if t.zone_bounds is not None else scan()


def _day(value) -> date | None:
    return value.date() if isinstance(value, datetime) else value


def latest_start(t: Tables) -> date | None:
    """MAX(fact_subscriptions.start_date): the revenue anchor D."""
    return _cached(t, "latest_start", lambda: _day(_greatest(
        t, "fact_subscriptions", lambda: t.subscriptions.agg(F.max("start_date")).first()[0])))


def latest_created(t: Tables) -> date | None:
    """MAX(dim_accounts.created_at)."""
    return _cached(t, "latest_created", lambda: _day(_greatest(
        t, "dim_accounts", lambda: t.accounts.agg(F.max("created_at")).first()[0])))


# Partition column of a stored, month-partitioned fact_events.
EVENT_MONTH = "event_month"


def latest_event(t: Tables) -> datetime | None:
    """MAX(fact_events.event_timestamp): the usage anchor T.

    On a stored fact partitioned by month without a zone map, the maximum lies
    in the latest month, so the latest partition is found first and only it is
    scanned."""
    def scan():
        ev = t.events
        if EVENT_MONTH in ev.columns:
            last = ev.agg(F.max(EVENT_MONTH)).first()[0]
            if last is None:
                return None
            ev = ev.where(F.col(EVENT_MONTH) == F.lit(last))
        return ev.agg(F.max("event_timestamp")).first()[0]

    return _cached(t, "latest_event", lambda: _greatest(t, "fact_events", scan))


def calendar_month(t: Tables, year: int | None, month: int | None) -> tuple[date | None, date | None]:
    """(first, last) calendar-table day of a month; (None, None) if the
    calendar has no day in it. When the calendar is known to hold every day of
    a range (``Tables.calendar_span``, set by ``load_star``), the
    bounds follow from the range; otherwise they are looked up."""
    if year is None or month is None:
        return (None, None)

    def compute():
        if t.calendar_span is not None:
            span = _cached(t, "calendar_span", t.calendar_span)
            # the star's calendar is every day of a known range: no job needed
            lo = max(span[0], date(year, month, 1))
            hi = min(span[1], date(year, month, monthrange(year, month)[1]))
            return (lo, hi) if lo <= hi else (None, None)
        row = (t.dates.where((F.year("date") == year) & (F.month("date") == month))
               .agg(F.min("date"), F.max("date")).first())
        return (row[0], row[1])

    return _cached(t, ("calendar_month", year, month), compute)


def year_start(d: date | None) -> date | None:
    return None if d is None else date(d.year, 1, 1)


def months_before(d: date | None, n: int) -> date | None:
    """d - INTERVAL 'n MONTH' (day clamped to the month's end)."""
    if d is None:
        return None
    y, m = divmod(d.year * 12 + d.month - 1 - n, 12)
    m += 1
    return date(y, m, min(d.day, monthrange(y, m)[1]))


def previous_month(d: date | None) -> tuple[int | None, int | None]:
    """(year, month) of the month before d's month (January rolls back)."""
    if d is None:
        return (None, None)
    p = months_before(date(d.year, d.month, 1), 1)
    return (p.year, p.month)


def date_lit(d: date | None) -> Column:
    return F.lit(d).cast("date") if d is not None else F.lit(None).cast("date")


def ts_lit(ts: datetime | date | None) -> Column:
    """A TIMESTAMP_NTZ literal, independent of the session time zone."""
    if ts is None:
        return F.lit(None).cast("timestamp_ntz")
    if not isinstance(ts, datetime):
        ts = datetime(ts.year, ts.month, ts.day)
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")
