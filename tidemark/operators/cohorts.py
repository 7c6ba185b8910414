"""Cohort views: survival of the previous year's subscription cohort.

Cohort: subscriptions started in year Y-1 (Y = year of D) that did not also
end in Y-1 (end_date NULL or outside Y-1), any status.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import anchors as A
from tidemark.functions.fixed import CANCELLED
from tidemark.functions.views import parent
from tidemark.params import Params
from tidemark.sources.star import Tables


def _prev_year(t: Tables) -> tuple[int | None, date | None, date | None]:
    d = A.latest_start(t)
    if d is None:
        return (None, None, None)
    return (d.year, date(d.year - 1, 1, 1), date(d.year - 1, 12, 31))


def cohort(t: Tables) -> DataFrame:
    _, lo, hi = _prev_year(t)
    lo_c, hi_c = A.date_lit(lo), A.date_lit(hi)
    return t.subscriptions.where(
        F.col("start_date").between(lo_c, hi_c)
        & (F.col("end_date").isNull() | ~F.col("end_date").between(lo_c, hi_c)))


def _running(steps: DataFrame) -> DataFrame:
    # Input is at most 1 + 12 rows by construction (start row + one per
    # cancellation month), so the single-partition running sum is bounded.
    w = Window.orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select("date", F.sum("delta").over(w).cast("bigint").alias("effective_sub_count"))


def cohort_survival(t: Tables, p: Params) -> DataFrame:
    """E4 (= V20): (Dec 31 of Y-1, cohort size), then per month m of the
    cohort's Cancelled end dates (Y-m-01, -count), as a running total by date.

    Kept from the original: a cancellation is dated in year Y whatever year it
    ended in. Repaired: the original builds the month text as '-0' || m
    (malformed for Oct-Dec) and breaks on a Cancelled row without end_date;
    here the date is make_date(Y, m, 1) and such rows only count in the start
    row.

    One scan: the cohort is aggregated once by cancellation month (<= 13
    groups); the start row is the sum of those groups.
    """
    y, _, hi = _prev_year(t)
    cancel_month = F.when((F.col("status") == CANCELLED) & F.col("end_date").isNotNull(),
                          F.month("end_date"))
    by_month = (cohort(t).groupBy(cancel_month.alias("cancel_month"))
                .agg(F.count("subscription_id").alias("n")))
    # Each group adds n to the start row and, if it is a cancellation month,
    # -n to that month's row; summing per date gives both kinds of row from
    # the one aggregate (an empty cohort gives no rows, as GROUP BY does).
    steps = by_month.select(F.explode(F.array(
        F.struct(A.date_lit(hi).alias("date"), F.col("n").alias("delta")),
        F.struct(F.make_date(F.lit(y), F.col("cancel_month"), F.lit(1)).alias("date"),
                 (-F.col("n")).alias("delta")),
    )).alias("s")).select("s.date", "s.delta").where(F.col("date").isNotNull())
    return _running(steps.groupBy("date").agg(F.sum("delta").alias("delta")))


def sub_trend(t: Tables, p: Params) -> DataFrame:
    """The same statement as E4."""
    return parent(t, p, cohort_survival)


def monthwise_cancelled(t: Tables, p: Params) -> DataFrame:
    """The cohort by end month (0 when no end date) and status, all
    statuses."""
    return (cohort(t).groupBy(F.month("end_date").alias("m"), "status")
            .agg(F.count("subscription_id").alias("sub_count"))
            .select(F.coalesce("m", F.lit(0)).cast("int").alias("month_num"), "status", "sub_count"))


def retention_cohort(t: Tables, p: Params, trend: DataFrame | None = None) -> DataFrame:
    """Effective count at the first and at the last date of V20 and
    their ratio. Dates in V20 are unique, so this is one row (none if V20 is
    empty)."""
    trend = parent(t, p, sub_trend) if trend is None else trend
    one = trend.groupBy(F.lit(1).alias("k")).agg(
        F.min_by("effective_sub_count", "date").alias("inital_sub_count"),
        F.max_by("effective_sub_count", "date").alias("final_sub_count"))
    return one.select(
        "inital_sub_count", "final_sub_count",
        (F.col("final_sub_count").cast("double") / F.col("inital_sub_count")).alias("cohort_retention"))
