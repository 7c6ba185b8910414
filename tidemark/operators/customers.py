"""Customer views: acquisition, churn, renewals, seat utilization, auto-renew.

Churn rule: an account is "Not Churned" if any of its subscriptions in scope
has a status containing 'Active' (case-sensitive LIKE '%Active%'), else
"Churned" (all-NULL statuses count as churned).
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import anchors as A
from tidemark.functions.fixed import ACTIVE, ACTIVE_LIKE, CHURNED, NOT_CHURNED
from tidemark.functions.joins import account_attrs, in_dim, with_account
from tidemark.functions.predicates import ATTRS, SLICE, is_active_status, open_at
from tidemark.functions.views import parent, stored
from tidemark.params import Params
from tidemark.sources.star import Tables

# --------------------------------------------------------------- acquisition

def new_customers_window(t: Tables) -> tuple[date | None, date | None]:
    """YTD window on account creation: Jan 1 of the latest creation year up to
    the last calendar day of its month; if the latest creation is in January,
    the whole previous year instead."""
    c = A.latest_created(t)
    if c is None:
        return (None, None)
    if c.month == 1:
        return (date(c.year - 1, 1, 1), date(c.year - 1, 12, 31))
    return (date(c.year, 1, 1), A.calendar_month(t, c.year, c.month)[1])


def new_customers_by_segment(t: Tables, p: Params) -> DataFrame:
    """Distinct accounts created in the YTD window, per segment, most
    first."""
    lo, hi = new_customers_window(t)
    return (t.accounts.where(F.col("created_at").between(A.date_lit(lo), A.date_lit(hi)))
            .groupBy("segment")
            .agg(F.count_distinct("account_sk").alias("customer_count"))
            .orderBy(F.col("customer_count").desc_nulls_first()))


def dim_segment_view(t: Tables, p: Params) -> DataFrame:
    """V2: distinct segments (a NULL segment is one row)."""
    return t.accounts.select("segment").distinct()


def dim_industry_view(t: Tables, p: Params) -> DataFrame:
    """V3: distinct industries."""
    return t.accounts.select("industry").distinct()


# --------------------------------------------------------------------- churn

def churn_flags_ytd(t: Tables) -> DataFrame:
    """Per account (in dim_accounts) with a subscription live on Jan 1 of D's
    year, whatever its status: has_active flag.

    The original string-aggregates the statuses and self-joins to de-duplicate;
    only "any status LIKE '%Active%'" is used, which is a max() per account:
    a plain hash aggregate with map-side partial aggregation, so a very large
    account costs one partial row per task, and the dimension join then
    carries one row per account.
    """
    b = A.year_start(A.latest_start(t))
    base = (t.subscriptions
            .where((F.col("start_date") <= A.date_lit(b)) & open_at(b))
            .select("account_sk", "status"))
    flags = base.groupBy("account_sk").agg(F.max(is_active_status()).alias("has_active"))
    return in_dim(flags, t.accounts, "account_sk")


def churn_summary_ytd(t: Tables, p: Params) -> DataFrame:
    """Total accounts in the churn base, churned accounts, churn rate in
    percent. Empty base -> (0, NULL, NULL)."""
    churned = F.sum(F.when(F.col("has_active"), 0).otherwise(1))
    total = F.count("*")
    return churn_flags_ytd(t).agg(
        total.alias("total_accounts"),
        churned.cast("bigint").alias("churned_accounts"),
        (churned.cast("double") / total * 100).alias("churn_rate"),
    )


def churn_rate(t: Tables, p: Params) -> DataFrame:
    """V9: E2's churn rate alone."""
    return parent(t, p, churn_summary_ytd).select("churn_rate")


def churn_status(t: Tables, p: Params) -> DataFrame:
    """Every account with subscriptions (no date filter, no dim join;
    NULL account keys dropped): its statuses and churn flag.

    The original concatenates one status per subscription in no defined order,
    a string that grows without bound for a large account. What it holds is
    kept in bounded form: agg_status lists each status once, sorted, and
    status_counts how many subscriptions have it (`Active:2,Paused:1`); both
    are NULL if all statuses are NULL.
    """
    return _churn_status(_status_counts(t))


def _status_counts(t: Tables) -> DataFrame:
    """One row per account and status: a hash aggregate on the raw rows,
    combined map-side whatever the size of the account."""
    return (t.subscriptions.where(F.col("account_sk").isNotNull())
            .groupBy("account_sk", "status").agg(F.count(F.lit(1)).alias("n")))


def _churn_status(counts: DataFrame) -> DataFrame:
    known = F.when(F.col("status").isNotNull(), F.struct("status", "n"))
    agg = counts.groupBy("account_sk").agg(F.array_sort(F.collect_list(known)).alias("s"))
    pairs = F.transform("s", lambda x: F.concat(x["status"], F.lit(":"), x["n"].cast("string")))
    return agg.select(
        "account_sk",
        F.when(F.size("s") > 0, F.array_join(F.col("s.status"), ",")).alias("agg_status"),
        F.when(F.size("s") > 0, F.array_join(pairs, ",")).alias("status_counts"),
        F.when(F.exists("s", lambda x: x["status"].like(ACTIVE_LIKE)), NOT_CHURNED)
        .otherwise(CHURNED).alias("churned_status"),
    )


def _accounts_since_year_start(t: Tables, p: Params, status: str) -> DataFrame:
    y0 = A.year_start(A.latest_start(t))
    new = (t.accounts.where(F.col("created_at") >= A.date_lit(y0))
           .withColumn("year_begin_date", A.date_lit(y0)))
    flags = stored(t, p, churn_status)
    if flags is None:
        # Only the new accounts' statuses are gathered.
        flags = _churn_status(in_dim(_status_counts(t), new.select("account_sk").distinct(), "account_sk"))
    return new.join(flags.where(F.col("churned_status") == status), "account_sk").select(
        "account_sk", "segment", "industry", "hq_country", "created_at",
        "year_begin_date", "agg_status", "status_counts", "churned_status")


def active_users(t: Tables, p: Params) -> DataFrame:
    """Accounts created since Jan 1 of D's year that are not churned
    (the original's LEFT JOIN + filter on the right side is an inner join)."""
    return _accounts_since_year_start(t, p, NOT_CHURNED)


def churned_users(t: Tables, p: Params) -> DataFrame:
    """Same, churned. (The original's last line names an undefined CTE;
    the evident intent, the churned set, is built.)"""
    return _accounts_since_year_start(t, p, CHURNED)


# ------------------------------------------------------------------ renewals

def renewals_due(t: Tables, p: Params) -> DataFrame:
    """Active subscriptions renewing in [as_of, as_of + renewal_days].
    Inner joins drop subscriptions without account/product/plan rows."""
    lo, hi = p.as_of, p.as_of + timedelta(days=p.renewal_days)
    subs = t.subscriptions.where(
        (F.col("status") == ACTIVE)
        & F.col("renewal_date").between(A.date_lit(lo), A.date_lit(hi)))
    return (with_account(t, subs, ["subscription_id", "renewal_date"])
            .join(t.products, "product_sk")
            .join(t.plans, "plan_sk")
            .select("account_sk", "subscription_id", "product_name", "plan_name",
                    "status", "renewal_date"))


def renewal_pipeline(t: Tables, p: Params) -> DataFrame:
    """E3 without the subscription id (a plain view: as_of is read time)."""
    return parent(t, p, renewals_due).drop("subscription_id")


def flagged_subscriptions(t: Tables) -> DataFrame:
    """Active subscriptions with the auto-renew flag set either way (NULL flag:
    in neither view)."""
    return (t.subscriptions.where((F.col("status") == ACTIVE) & F.col("is_auto_renew").isNotNull())
            .select("subscription_id", "account_sk", "product_sk", "is_auto_renew"))


def auto_renew_subscriptions(t: Tables) -> DataFrame:
    """The flagged subscriptions with their account's slice."""
    return flagged_subscriptions(t).join(account_attrs(t, *ATTRS), "account_sk")


def _auto_renew_counts(t: Tables, flag: bool, name: str) -> DataFrame:
    return (auto_renew_subscriptions(t).where(F.col("is_auto_renew") == F.lit(flag))
            .groupBy(*SLICE)
            .agg(F.count_distinct("subscription_id").alias(name))
            .select(name, *SLICE))


def renew_disabled(t: Tables, p: Params) -> DataFrame:
    """Distinct Active subscriptions with auto-renew off, per slice
    (NULL flag counts in neither V17 nor V18)."""
    return _auto_renew_counts(t, False, "renew_disabled_count")


def renew_enabled(t: Tables, p: Params) -> DataFrame:
    """Same with auto-renew on."""
    return _auto_renew_counts(t, True, "renew_enabled_count")


# --------------------------------------------------------- seat utilization

def _fanned(seats: str) -> Column:
    """n * seats as an exact decimal(38,0): with one account holding a large
    share of all subscriptions, the fan-out sums pass the bigint range
    (published as float8, like money)."""
    return F.col("n").cast("decimal(38,0)") * F.col(seats)


def _seat_fanout(t: Tables) -> DataFrame:
    """Per (account, product) with open Active subscriptions: n, their count
    (the account's fact_mrr_accounts rows for that product), and the seats of
    all the account's subscriptions, any status.

    The original joins fact_mrr_accounts to fact_subscriptions on the account,
    pairing each open Active subscription with every subscription of the
    account, so its sums are sum over (account, product) of n * seats(account).
    One scan: subscriptions are aggregated per (account, product) (partial
    aggregation map-side), the account's seat totals are a window sum over its
    few product rows, and the pairs are never materialised.
    """
    open_active = (F.col("status") == ACTIVE) & F.col("end_date").isNull()
    per_product = t.subscriptions.groupBy("account_sk", "product_sk").agg(
        F.count_if(open_active).alias("n"),
        F.sum("seat_commit").alias("commit"), F.sum("seat_provisioned").alias("provisioned"))
    account = Window.partitionBy("account_sk")
    return (per_product
            .select("account_sk", "product_sk", "n",
                    F.sum("commit").over(account).alias("commit"),
                    F.sum("provisioned").over(account).alias("provisioned"))
            .where(F.col("n") > 0))


def overall_utilization(t: Tables, p: Params) -> DataFrame:
    """SUM of seats over `fact_mrr_accounts JOIN fact_subscriptions USING
    (account_sk)` (see `_seat_fanout`); accounts must be in dim_accounts, as
    fact_mrr_accounts requires."""
    return in_dim(_seat_fanout(t), t.accounts, "account_sk").agg(
        F.sum(_fanned("commit")).alias("total_seat_commits"),
        F.sum(_fanned("provisioned")).alias("total_seat_provisions"))


def specific_utilization(t: Tables, p: Params) -> DataFrame:
    """V14 per slice of the fact_mrr_accounts side (its product and the
    account's attributes)."""
    return (_seat_fanout(t).join(account_attrs(t, *ATTRS), "account_sk")
            .groupBy(*SLICE).agg(
                F.sum(_fanned("commit")).alias("specific_seat_commits"),
                F.sum(_fanned("provisioned")).alias("specific_seat_provisions")))
