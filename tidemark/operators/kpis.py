"""Dashboard KPIs computed from the views.

The formulas are inferred from the report titles (the BI file holding them is
not part of the original). Each takes the dashboard slicers from
``Params.slicers`` as equality filters on its input view.

KPIs comparing two views (growth, NRR, auto-renew share, feature adoption)
read the stored views when a materialization has written them (tiny tables),
summed in one aggregate over their tagged union. Otherwise they are computed
in one pass over the star: conditional aggregates over a single scan of the
fact, never two scans and a join of two one-row results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import anchors as A
from tidemark.functions.fixed import FEATURE_USE, MONTHS_PER_YEAR
from tidemark.functions.joins import account_attrs
from tidemark.functions.predicates import ATTRS, SLICE, live_at, ratio
from tidemark.functions.views import parent, stored
from tidemark.operators import customers, revenue, usage
from tidemark.params import Params
from tidemark.sources.star import Tables


def sliced(df: DataFrame, p: Params, t: Tables | None = None) -> DataFrame:
    """Apply the slicers. An account attribute the rows lack is joined to them
    by account; a name that is neither is an error."""
    missing = [c for c in p.slicers if c not in df.columns]
    if missing:
        if t is None or "account_sk" not in df.columns or not set(missing) <= set(ATTRS):
            raise ValueError(f"no such slicer: {sorted(set(missing) - set(ATTRS)) or missing}")
        df = df.join(account_attrs(t, *missing), "account_sk")
    for col, value in p.slicers.items():
        df = df.where(F.col(col) == F.lit(value))
    return df


def _sum_pair(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """(SUM(a.col), SUM(b.col)) in one aggregate."""
    tagged = (a.select(F.lit(True).alias("is_a"), F.col(col).alias("v"))
              .unionByName(b.select(F.lit(False).alias("is_a"), F.col(col).alias("v"))))
    return tagged.agg(F.sum(F.when(F.col("is_a"), F.col("v"))).alias("a"),
                      F.sum(F.when(~F.col("is_a"), F.col("v"))).alias("b"))


def _growth(cur: Column, prior: Column) -> Column:
    """cur / prior - 1; NULL when the prior total is 0 or missing."""
    return ratio(cur, prior) - 1


def _current_mrr(t: Tables, p: Params) -> DataFrame:
    """V1's rows, or their sums per account and product where V1 isn't stored:
    totals are equal, and a large account sends a row per product to the join."""
    v1 = stored(t, p, revenue.mrr_arr_snapshot)
    if v1 is None:
        d = A.latest_start(t)
        v1 = revenue.live_mrr(t, d, d)
    return sliced(v1, p)


def kpi_mrr(t: Tables, p: Params) -> DataFrame:
    """K1: total MRR of the current snapshot (V1)."""
    return _current_mrr(t, p).agg(F.sum("net_mrr_usd").alias("mrr"))


def kpi_arr(t: Tables, p: Params) -> DataFrame:
    """K2: ARR = 12 * MRR."""
    return _current_mrr(t, p).agg((F.sum("net_mrr_usd") * MONTHS_PER_YEAR).alias("arr"))


def _mrr_growth(t: Tables, p: Params, prior_view, prior_bounds) -> DataFrame:
    """MRR at D and at a prior snapshot, and the growth. From the two stored
    views when a materialization wrote them; otherwise in one pass: one scan
    of the subscriptions, a conditional sum per snapshot (the same `live_at`
    rules as the views) per account and product, then the account join."""
    cur_v, prior_v = stored(t, p, revenue.mrr_arr_snapshot), stored(t, p, prior_view)
    if cur_v is not None and prior_v is not None:
        s = _sum_pair(sliced(cur_v, p), sliced(prior_v, p), "net_mrr_usd")
    else:
        d = A.latest_start(t)
        start_by, open_from = prior_bounds(t)
        now, then = live_at(d, d), live_at(start_by, open_from)
        per_product = t.subscriptions.where(now | then).groupBy("account_sk", "product_sk").agg(
            F.sum(F.when(now, F.col("net_mrr_usd"))).alias("now"),
            F.sum(F.when(then, F.col("net_mrr_usd"))).alias("then"))
        s = sliced(per_product.join(account_attrs(t, *ATTRS), "account_sk"), p).agg(
            F.sum("now").alias("a"), F.sum("then").alias("b"))
    return s.select(F.col("a").alias("mrr"), F.col("b").alias("prior_mrr"),
                    _growth(F.col("a"), F.col("b")).alias("mrr_growth"))


def _one_day(day_fn):
    return lambda t: (day_fn(t), day_fn(t))


def kpi_mrr_yoy(t: Tables, p: Params) -> DataFrame:
    """K3: MRR now over MRR in the same month a year earlier (V31), - 1."""
    return _mrr_growth(t, p, revenue.previous_window_mrr_snapshot, revenue.year_ago_month)


def kpi_mrr_mom(t: Tables, p: Params) -> DataFrame:
    """K4: MRR now over MRR at the end of the previous month (V5), - 1."""
    return _mrr_growth(t, p, revenue.fact_previous_month_net_mrr,
                       _one_day(revenue.previous_month_day))


def kpi_mrr_growth_vs_prior_december(t: Tables, p: Params) -> DataFrame:
    """K5: MRR now over MRR at Dec 31 of the previous year (V6), - 1."""
    return _mrr_growth(t, p, revenue.previous_year_mrr, _one_day(revenue.prior_december_day))


def kpi_nrr(t: Tables, p: Params) -> DataFrame:
    """K6: net revenue retention, SUM(V8) / SUM(V7), faithful to the original
    views (V8 counts an account's current MRR once per V7 row of the
    account; see `nrr_account_level` for the per-account version)."""
    cur_v = stored(t, p, revenue.current_mrr_for_nrr)
    prior_v = stored(t, p, revenue.previous_mrr_for_nrr)
    if cur_v is not None and prior_v is not None:
        s = _sum_pair(sliced(cur_v, p), sliced(prior_v, p), "net_mrr_usd")
    else:
        # one pass: V8's pair sums and V7's MRR from the same per-(account,
        # product) aggregate
        rows = sliced(revenue.nrr_by_account_product(t, p)
                      .join(account_attrs(t, *ATTRS), "account_sk"), p)
        s = rows.agg(
            F.sum(F.when((F.col("n_prior") > 0) & (F.col("n_now") > 0),
                         F.col("n_prior") * F.col("mrr_now"))).alias("a"),
            F.sum("mrr_prior").alias("b"))
    return s.select(F.col("a").alias("current_mrr"), F.col("b").alias("prior_mrr"),
                    ratio(F.col("a"), F.col("b")).alias("nrr"))


def _share(df: DataFrame, key: str, value: str, share: str) -> DataFrame:
    # Rows are already aggregated per key (products, segments: bounded by
    # their dimension), so the unpartitioned total runs over a handful of rows.
    total = F.sum(value).over(Window.partitionBy())
    return df.select(key, value, ratio(F.col(value), total).alias(share))


def kpi_revenue_share_by_product(t: Tables, p: Params) -> DataFrame:
    """K7: each product's share of current MRR."""
    per = (_current_mrr(t, p).groupBy("product_sk")
           .agg(F.sum("net_mrr_usd").alias("mrr")))
    return _share(per, "product_sk", "mrr", "revenue_share")


def kpi_churned_revenue_by_industry(t: Tables, p: Params) -> DataFrame:
    """K8: churned revenue (V34) per industry."""
    return (sliced(parent(t, p, revenue.churn_revenue), p).groupBy("industry")
            .agg(F.sum("churn_revenue").alias("churn_revenue")))


def kpi_active_base_share_by_segment(t: Tables, p: Params) -> DataFrame:
    """K9: distinct accounts with open Active subscriptions (V4) per segment,
    and their share of all such accounts (an account has one segment, so the
    per-segment counts add up to the total)."""
    v4 = stored(t, p, revenue.fact_mrr_accounts)
    if v4 is None:
        # V4's accounts and products, each pair once before the account join
        v4 = (revenue.open_active(t).groupBy("account_sk", "product_sk").agg(F.count(F.lit(1)).alias("n"))
              .join(account_attrs(t, *ATTRS), "account_sk"))
    accounts = sliced(v4, p).select("segment", "account_sk").distinct()
    per = accounts.groupBy("segment").agg(F.count("account_sk").alias("active_accounts"))
    return _share(per, "segment", "active_accounts", "active_share")


def kpi_revenue_by_segment(t: Tables, p: Params) -> DataFrame:
    """Current MRR per segment."""
    return (_current_mrr(t, p).groupBy("segment")
            .agg(F.sum("net_mrr_usd").alias("mrr")))


def kpi_seat_utilization(t: Tables, p: Params) -> DataFrame:
    """Provisioned / committed seats from the utilization view; summing
    V15's slices gives V14, and lets the slicers apply."""
    s = sliced(parent(t, p, customers.specific_utilization), p).agg(
        F.sum("specific_seat_commits").alias("total_seat_commits"),
        F.sum("specific_seat_provisions").alias("total_seat_provisions"))
    return s.select("total_seat_commits", "total_seat_provisions",
                    ratio(F.col("total_seat_provisions"), F.col("total_seat_commits"))
                    .alias("seat_utilization"))


def kpi_auto_renew_share(t: Tables, p: Params) -> DataFrame:
    """Auto-renewing Active subscriptions and their share of those with
    the flag set either way."""
    on_v, off_v = stored(t, p, customers.renew_enabled), stored(t, p, customers.renew_disabled)
    if on_v is not None and off_v is not None:
        s = _sum_pair(sliced(on_v, p).withColumnRenamed("renew_enabled_count", "n"),
                      sliced(off_v, p).withColumnRenamed("renew_disabled_count", "n"), "n")
    else:
        # one pass: each subscription once (both flags if its rows differ), its
        # account's counts per product, then both views' counts per slice
        flag = F.col("is_auto_renew")
        each = customers.flagged_subscriptions(t).groupBy("account_sk", "product_sk", "subscription_id").agg(
            F.max(flag).alias("on"), F.max(~flag).alias("off"))
        known = F.col("subscription_id").isNotNull()
        per_product = each.groupBy("account_sk", "product_sk").agg(
            F.count_if(F.col("on") & known).alias("on"), F.count_if(F.col("off") & known).alias("off"),
            F.max("on").alias("any_on"), F.max("off").alias("any_off"))
        per_slice = sliced(per_product.join(account_attrs(t, *ATTRS), "account_sk"), p).groupBy(*SLICE).agg(
            F.sum("on").alias("on"), F.sum("off").alias("off"),
            F.max("any_on").alias("any_on"), F.max("any_off").alias("any_off"))
        # a slice counts in a view only if the view has its row
        s = per_slice.agg(F.sum(F.when(F.col("any_on"), F.col("on"))).alias("a"),
                          F.sum(F.when(F.col("any_off"), F.col("off"))).alias("b"))
    return s.select(F.col("a").alias("auto_renew_count"), F.col("b").alias("manual_renew_count"),
                    ratio(F.col("a"), F.col("a") + F.col("b")).alias("auto_renew_share"))


def kpi_feature_adoption(t: Tables, p: Params) -> DataFrame:
    """Active (account, product) pairs that used a feature over all active
    pairs (V24's distinct pairs over V23's rows)."""
    adopted_v = stored(t, p, usage.feature_usage_adopted_users)
    active_v = stored(t, p, usage.feature_usage_active_users)
    if adopted_v is not None and active_v is not None:
        adopted = adopted_v.select(F.col("feature_users").alias("account_sk"), "product_sk").distinct()
        tagged = (sliced(adopted, p, t).select(F.lit(True).alias("is_a"))
                  .unionByName(sliced(active_v, p, t).select(F.lit(False).alias("is_a"))))
        s = tagged.agg(F.count_if(F.col("is_a")).alias("adopted_accounts"),
                       F.count_if(~F.col("is_a")).alias("active_accounts"))
    else:
        # one pass, no join: active pairs and feature-event pairs grouped
        # together by (account, product), both reduced map-side
        keys = ["account_sk", "product_sk"]
        pairs = usage.active_subscriptions(t, p).select(
            *keys, F.lit(True).alias("active"), F.lit(False).alias("used"))
        used = t.events.where(F.col("feature_sk").isNotNull()).select(
            *keys, F.lit(False).alias("active"), F.lit(True).alias("used"))
        per_pair = sliced(pairs.unionByName(used).groupBy(*keys).agg(
            F.max("active").alias("active"), F.max("used").alias("used")), p, t)
        joinable = F.col("account_sk").isNotNull() & F.col("product_sk").isNotNull()
        s = per_pair.agg(
            F.count_if(F.col("active") & F.col("used") & joinable).alias("adopted_accounts"),
            F.count_if(F.col("active")).alias("active_accounts"))
    return s.select("adopted_accounts", "active_accounts",
                    ratio(F.col("adopted_accounts"), F.col("active_accounts")).alias("feature_adoption"))


def kpi_device_adoption(t: Tables, p: Params) -> DataFrame:
    """Per device, distinct contacts with feature_use events over
    distinct contacts with any event. Distinct counts do not add across V27's
    rows, so this is recomputed from events (a rate per device, not a split:
    the rates of all devices may sum past 100 %). Slicers apply to the events'
    products and to their accounts."""
    used = (F.col("event_type") == FEATURE_USE) & F.col("feature_sk").isNotNull()
    ev = t.events
    if p.slicers:
        # only what the slicers need, reduced before the account join
        keys = ["device_type", "contact_sk", "account_sk", *[c for c in p.slicers if c in ev.columns]]
        ev = sliced(ev.groupBy(*dict.fromkeys(keys)).agg(F.max(used).alias("used")), p, t)
        used = F.col("used")
    per_contact = ev.groupBy("device_type", "contact_sk").agg(F.max(used).alias("used"))
    known = F.col("contact_sk").isNotNull()
    agg = per_contact.groupBy("device_type").agg(
        F.count_if(F.col("used") & known).alias("feature_users"), F.count_if(known).alias("total_users"))
    return agg.select("device_type", "feature_users", "total_users",
                      ratio(F.col("feature_users"), F.col("total_users")).alias("adoption_rate"))


def kpi_mrr_trend(t: Tables, p: Params) -> DataFrame:
    """MRR of open Active subscriptions (V4) by start month, with running
    totals of MRR and of accounts (an account counts from its first month).

    One pipeline: V4 summed per (account, month); the account's first month
    is a window minimum over its few month rows; then one row per month."""
    month = F.make_date(F.year("start_date"), F.month("start_date"), F.lit(1))
    v4 = stored(t, p, revenue.fact_mrr_accounts)
    if v4 is None:
        v4 = (revenue.open_active(t).groupBy("account_sk", "product_sk", month.alias("month"))
              .agg(F.sum("net_mrr_usd").alias("net_mrr_usd"))
              .join(account_attrs(t, *ATTRS), "account_sk"))
    else:
        v4 = v4.withColumn("month", month)
    per_account_month = sliced(v4, p).groupBy("account_sk", "month").agg(
        F.sum("net_mrr_usd").alias("mrr"))
    first = F.col("month").eqNullSafe(F.min("month").over(Window.partitionBy("account_sk")))
    monthly = (per_account_month.select("month", "mrr", first.alias("first"))
               .groupBy("month").agg(F.sum("mrr").alias("mrr"),
                                     F.count_if(F.col("first")).alias("new_accounts")))
    # One row per start month: bounded by the calendar, not by the data.
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly.select(
        "month", "mrr", F.sum("mrr").over(w).alias("cumulative_mrr"), "new_accounts",
        F.sum("new_accounts").over(w).cast("bigint").alias("cumulative_accounts"))
