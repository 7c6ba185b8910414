"""Revenue views: MRR snapshots at several anchors, NRR inputs, ACV, ARPA,
churned revenue.

Snapshot rule (`live_at`): Active, started on or before the snapshot day and
not ended before it. The anchor D is MAX(start_date) over all subscriptions.

Plans: one scan of fact_subscriptions with literal filters (pushed to parquet),
then a join to dim_accounts on account_sk for the attributes. dim_accounts grows
with the data, so that join is left to the planner (AQE broadcasts it at
runtime only if it is small, else sort-merge on account_sk); the row-level
views deal a hot account's rows over pieces first (joins.with_account).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import anchors as A
from tidemark.functions.fixed import ACTIVE, CANCELLED, MONTHS_PER_YEAR
from tidemark.functions.joins import account_attrs, with_account
from tidemark.functions.predicates import ATTRS, SLICE, live_at
from tidemark.params import Params
from tidemark.sources.star import Tables


def snapshot(t: Tables, start_by: date | None, open_from: date | None,
             with_start_date: bool = False) -> DataFrame:
    """Active subscriptions live over [start_by, open_from], with the account's
    attributes. One row per subscription."""
    subs = t.subscriptions.where(live_at(start_by, open_from))
    out = ["account_sk", "product_sk", *ATTRS] + (["start_date"] if with_start_date else []) + ["net_mrr_usd"]
    return with_account(t, subs, ["subscription_id", "start_date"], *ATTRS).select(*out)


def mrr_arr_snapshot(t: Tables, p: Params) -> DataFrame:
    """V1: subscriptions live at D."""
    d = A.latest_start(t)
    return snapshot(t, d, d)


def open_active(t: Tables) -> DataFrame:
    """Active subscriptions with no end date."""
    return t.subscriptions.where((F.col("status") == ACTIVE) & F.col("end_date").isNull())


def fact_mrr_accounts(t: Tables, p: Params) -> DataFrame:
    """V4: Active subscriptions with no end date (stricter than V1: no anchor,
    and a future end date excludes)."""
    return with_account(t, open_active(t), ["subscription_id", "start_date"], *ATTRS).select(
        "account_sk", "product_sk", *ATTRS, "start_date", "net_mrr_usd")


def previous_month_day(t: Tables) -> date | None:
    """Last calendar day of the month before D's month."""
    y, m = A.previous_month(A.latest_start(t))
    return A.calendar_month(t, y, m)[1]


def fact_previous_month_net_mrr(t: Tables, p: Params) -> DataFrame:
    """V5: snapshot at the last calendar day of the month before D, with
    start_date. The original sorts the stored view by start_date desc; a stored
    table keeps no order, so readers sort."""
    day = previous_month_day(t)
    return snapshot(t, day, day, with_start_date=True)


def prior_december_day(t: Tables) -> date | None:
    """Dec 31 of the year before D."""
    d = A.latest_start(t)
    return None if d is None else date(d.year - 1, 12, 31)


def previous_year_mrr(t: Tables, p: Params) -> DataFrame:
    """V6: snapshot at Dec 31 of the year before D."""
    day = prior_december_day(t)
    return snapshot(t, day, day)


def nrr_base_day(t: Tables, p: Params) -> date | None:
    """Last calendar day of the month `nrr_months_back` months before D."""
    m = A.months_before(A.latest_start(t), p.nrr_months_back)
    return A.calendar_month(t, m.year if m else None, m.month if m else None)[1]


def previous_mrr_for_nrr(t: Tables, p: Params) -> DataFrame:
    """V7: the NRR base, a snapshot at `nrr_base_day` (11 months back by
    default, as in the original)."""
    day = nrr_base_day(t, p)
    return snapshot(t, day, day)


def nrr_by_account_product(t: Tables, p: Params) -> DataFrame:
    """Per (account, product), from one scan of the subscriptions: n_prior,
    the subscriptions live at the NRR base day (the account's V7 rows for the
    product), and the account's subscriptions live at D: their count n_now
    and MRR mrr_now (a window sum over the account's few product rows).
    mrr_prior is the base-day MRR of the product's rows."""
    d, base = A.latest_start(t), nrr_base_day(t, p)
    now, then = live_at(d, d), live_at(base, base)
    # Only rows live at one of the two days count: the status and date bounds
    # reach the scan (and prune the stored star's status partitions).
    per_product = t.subscriptions.where(now | then).groupBy("account_sk", "product_sk").agg(
        F.count_if(then).alias("n_prior"),
        F.sum(F.when(then, F.col("net_mrr_usd"))).alias("mrr_prior"),
        F.count_if(now).alias("n_now_p"),
        F.sum(F.when(now, F.col("net_mrr_usd"))).alias("mrr_now_p"))
    account = Window.partitionBy("account_sk")
    return per_product.select(
        "account_sk", "product_sk", "n_prior", "mrr_prior",
        F.sum("n_now_p").over(account).alias("n_now"),
        F.sum("mrr_now_p").over(account).alias("mrr_now"))


def current_mrr_for_nrr(t: Tables, p: Params) -> DataFrame:
    """V8: current MRR of the accounts in the NRR base.

    The original joins every V7 row of an account to every subscription of the
    account live at D (USING account_sk) and outputs the pairs: V7's product
    and attributes with the current sub's net_mrr_usd. That output has
    n_prev(a) * n_cur(a) rows per account, quadratic in a large account, so it
    is published pre-summed at the V7 grain instead: per (account, V7 product,
    attributes) the pair sum of net_mrr_usd (= count of such V7 rows * the
    account's current MRR) and the number of pairs. Every sum or slicer filter
    over the original rows gives the same total here. One scan of the
    subscriptions (`nrr_by_account_product`); no pair is materialised.
    """
    rows = nrr_by_account_product(t, p).where((F.col("n_prior") > 0) & (F.col("n_now") > 0))
    return rows.join(account_attrs(t, *ATTRS), "account_sk").select(
        "account_sk", "product_sk", *ATTRS,
        (F.col("n_prior") * F.col("mrr_now")).alias("net_mrr_usd"),
        # exact; a large account's pair count can pass the bigint range
        (F.col("n_prior").cast("decimal(38,0)") * F.col("n_now")).alias("pair_count"),
    )


def previous_window_mrr_snapshot(t: Tables, p: Params) -> DataFrame:
    """Subscriptions live for the whole calendar month one year before D
    (started by its first day, not ended before its last)."""
    first, last = year_ago_month(t)
    return snapshot(t, first, last)


def year_ago_month(t: Tables) -> tuple[date | None, date | None]:
    """First and last calendar day of the month one year before D."""
    m = A.months_before(A.latest_start(t), 12)
    return A.calendar_month(t, m.year if m else None, m.month if m else None)


def _ytd_active(t: Tables) -> DataFrame:
    d = A.latest_start(t)
    return t.subscriptions.where(
        (F.col("status") == ACTIVE)
        & F.col("start_date").between(A.date_lit(A.year_start(d)), A.date_lit(d)))


def _per_account_product(subs: DataFrame) -> DataFrame:
    """MRR summed per (account, product) before the dimension join: the join
    then carries at most one row per product for an account of any size."""
    return subs.groupBy("account_sk", "product_sk").agg(F.sum("net_mrr_usd").alias("mrr"))


def live_mrr(t: Tables, start_by: date | None, open_from: date | None) -> DataFrame:
    """A snapshot's MRR per account and product, with the account's attributes:
    what totals over `snapshot` need, without a row per subscription."""
    return (_per_account_product(t.subscriptions.where(live_at(start_by, open_from)))
            .join(account_attrs(t, *ATTRS), "account_sk")
            .select("account_sk", *SLICE, F.col("mrr").alias("net_mrr_usd")))


def acv(t: Tables, p: Params) -> DataFrame:
    """Annualised MRR of Active subs started this year (Jan 1 of D's year
    .. D), per account and slice. The account key is grouped on but not
    output, as in the original, so a slice repeats once per account."""
    return (_per_account_product(_ytd_active(t))
            .join(account_attrs(t, *ATTRS), "account_sk")
            .select(*SLICE, (F.col("mrr") * MONTHS_PER_YEAR).alias("total_acv")))


def arpa(t: Tables, p: Params) -> DataFrame:
    """Annual revenue per account, per slice: SUM(net_mrr)*12 over the
    distinct accounts of the slice (one row an account, as the slice holds the
    product and dim_accounts has a row per key). Published as float8."""
    return (_per_account_product(_ytd_active(t))
            .join(account_attrs(t, *ATTRS), "account_sk")
            .groupBy(*SLICE)
            .agg(((F.sum("mrr") * MONTHS_PER_YEAR).cast("double")
                  / F.count("account_sk")).alias("annual_arpa")))


def churn_revenue(t: Tables, p: Params) -> DataFrame:
    """Annualised MRR of Cancelled subs that ended this year (Jan 1 of
    D's year .. D), per slice."""
    d = A.latest_start(t)
    ended = t.subscriptions.where(
        (F.col("status") == CANCELLED)
        & F.col("end_date").between(A.date_lit(A.year_start(d)), A.date_lit(d)))
    return (_per_account_product(ended)
            .join(account_attrs(t, *ATTRS), "account_sk")
            .groupBy(*SLICE)
            .agg((F.sum("mrr") * MONTHS_PER_YEAR).alias("churn_revenue")))
