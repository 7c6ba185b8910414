"""Corrected variants of results that run as written but mislead. They are
separate keys; the faithful views are unchanged."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import anchors as A
from tidemark.functions.fixed import ACTIVE, CANCELLED
from tidemark.functions.joins import in_dim
from tidemark.functions.predicates import live_at, ratio
from tidemark.operators import cohorts, revenue
from tidemark.params import Params
from tidemark.sources.star import Tables


def seat_utilization_exact(t: Tables, p: Params) -> DataFrame:
    """Seats of the open Active subscriptions (V4's rows) counted once each,
    instead of once per open Active subscription of the account (V14)."""
    per_account = (t.subscriptions.where((F.col("status") == ACTIVE) & F.col("end_date").isNull())
                   .groupBy("account_sk").agg(F.sum("seat_commit").alias("commit"),
                                              F.sum("seat_provisioned").alias("provisioned")))
    s = in_dim(per_account, t.accounts, "account_sk").agg(
        F.sum("commit").alias("total_seat_commits"), F.sum("provisioned").alias("total_seat_provisions"))
    return s.select("total_seat_commits", "total_seat_provisions",
                    ratio(F.col("total_seat_provisions"), F.col("total_seat_commits"))
                    .alias("seat_utilization"))


def nrr_account_level(t: Tables, p: Params) -> DataFrame:
    """NRR with each retained account's current MRR counted once: current MRR
    (live at D) of the accounts in the NRR base over the base's MRR. One scan
    of the subscriptions, reduced to one row per account."""
    d, base = A.latest_start(t), revenue.nrr_base_day(t, p)
    now, then = live_at(d, d), live_at(base, base)
    per_account = in_dim(t.subscriptions.where(now | then).groupBy("account_sk").agg(
        F.count_if(then).alias("n_prior"),
        F.sum(F.when(then, F.col("net_mrr_usd"))).alias("mrr_prior"),
        F.sum(F.when(now, F.col("net_mrr_usd"))).alias("mrr_now")), t.accounts, "account_sk")
    s = per_account.agg(
        F.sum(F.when(F.col("n_prior") > 0, F.col("mrr_now"))).alias("current_mrr"),
        F.sum("mrr_prior").alias("prior_mrr"))
    return s.select("current_mrr", "prior_mrr",
                    ratio(F.col("current_mrr"), F.col("prior_mrr")).alias("nrr"))


def cohort_survival_calendar(t: Tables, p: Params) -> DataFrame:
    """Cohort survival with each cancellation on its real month (year and
    month of end_date) and only cancellations up to D."""
    d = A.latest_start(t)
    hi = None if d is None else date(d.year - 1, 12, 31)
    cancel_month = F.when((F.col("status") == CANCELLED) & (F.col("end_date") <= A.date_lit(d)),
                          F.make_date(F.year("end_date"), F.month("end_date"), F.lit(1)))
    by_month = (cohorts.cohort(t).groupBy(cancel_month.alias("m"))
                .agg(F.count("subscription_id").alias("n")))
    steps = by_month.select(F.explode(F.array(
        F.struct(A.date_lit(hi).alias("date"), F.col("n").alias("delta")),
        F.struct(F.col("m").alias("date"), (-F.col("n")).alias("delta")),
    )).alias("s")).select("s.date", "s.delta").where(F.col("date").isNotNull())
    steps = steps.groupBy("date").agg(F.sum("delta").alias("delta"))
    # Months between the cohort year and D: bounded by the calendar.
    w = Window.orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select("date", F.sum("delta").over(w).cast("bigint").alias("effective_sub_count"))
