"""Anchor date arithmetic (PostgreSQL interval semantics)."""

from __future__ import annotations

from datetime import date, datetime

from tidemark.functions import anchors as A


def test_months_before_clamps_to_month_end():
    # '2025-01-31' - INTERVAL '11 MONTH' = 2024-02-29 (leap year, clamped)
    assert A.months_before(date(2025, 1, 31), 11) == date(2024, 2, 29)
    assert A.months_before(date(2025, 3, 31), 1) == date(2025, 2, 28)
    assert A.months_before(date(2025, 7, 31), 12) == date(2024, 7, 31)
    assert A.months_before(None, 3) is None


def test_previous_month_rolls_back_in_january():
    assert A.previous_month(date(2025, 1, 15)) == (2024, 12)
    assert A.previous_month(date(2025, 8, 1)) == (2025, 7)
    assert A.previous_month(None) == (None, None)


def test_year_start():
    assert A.year_start(date(2025, 7, 31)) == date(2025, 1, 1)
    assert A.year_start(None) is None


def test_literals_are_typed_and_zone_free(spark):
    row = spark.range(1).select(
        A.date_lit(date(2025, 2, 28)).alias("d"), A.date_lit(None).alias("dn"),
        A.ts_lit(datetime(2024, 12, 31, 0, 0, 1)).alias("t"), A.ts_lit(None).alias("tn"),
        A.ts_lit(date(2024, 12, 31)).alias("td"),
    )
    assert [f.dataType.simpleString() for f in row.schema.fields] == [
        "date", "date", "timestamp_ntz", "timestamp_ntz", "timestamp_ntz"]
    r = row.collect()[0]
    assert (r.d, r.dn, r.t, r.tn, r.td) == (date(2025, 2, 28), None, datetime(2024, 12, 31, 0, 0, 1),
                                             None, datetime(2024, 12, 31))


def test_calendar_month_bounds(spark):
    from tidemark.sources.star import Tables, dim_date
    t = Tables(spark, dates=dim_date(spark, date(2019, 1, 1), date(2026, 12, 31)))
    assert A.calendar_month(t, 2024, 2) == (date(2024, 2, 1), date(2024, 2, 29))
    assert A.calendar_month(t, 2030, 1) == (None, None)   # outside the calendar
    assert A.calendar_month(t, None, None) == (None, None)


def test_calendar_span_matches_lookup(spark):
    from tidemark.sources.star import Tables, dim_date
    span = (date(2019, 1, 1), date(2026, 12, 31))
    looked_up, known = (Tables(spark, dates=dim_date(spark, *span)) for _ in range(2))
    known.calendar_span = lambda: span
    for y, m in [(2018, 12), (2019, 1), (2024, 2), (2025, 7), (2026, 12), (2027, 1)]:
        assert A.calendar_month(known, y, m) == A.calendar_month(looked_up, y, m), (y, m)
    partial = Tables(spark)
    partial.calendar_span = lambda: (date(2019, 1, 15), date(2026, 12, 31))
    assert A.calendar_month(partial, 2019, 1) == (date(2019, 1, 15), date(2019, 1, 31))
