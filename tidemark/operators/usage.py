"""Product-usage views over fact_events, the table that grows without bound.

Every view scans events once, pruned to the columns it needs, with its time
window as a literal range (pushed to parquet) before any join or shuffle.
Events are first reduced, map-side, to the distinct keys the view needs (one
row per account/product/contact, with the counts or flags it uses), so a
dimension join carries reduced rows, not events, and an account or product
holding a third of all events costs a few rows per task. Distinct counts are
exact (count_distinct); Spark plans them as a partial aggregate on (group,
counted column) before the shuffle, so a hot group is spread over its
distinct values, never sent whole to one task.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import anchors as A
from tidemark.functions import bloom
from tidemark.functions.fixed import ACTIVE, FEATURE_USE, LOGIN, PAGE_PATH, PAGE_VIEW
from tidemark.functions.joins import account_attrs, in_dim
from tidemark.functions.predicates import ATTRS, not_navigation, open_at, ratio
from tidemark.params import Params
from tidemark.sources.star import Tables
from tidemark.sources.zones import SHREDDED

# Stored fact_events are partitioned by this column (first day of the
# event's month); see tidemark.plans.materialize.
EVENT_MONTH = A.EVENT_MONTH


def events_between(t: Tables, lo: datetime | None, hi: datetime | None,
                   hi_inclusive: bool = False) -> DataFrame:
    """fact_events with lo <= event_timestamp < hi (or <= hi). On a stored,
    month-partitioned fact the same bounds are also put on the partition
    column, so whole months are pruned before any file is opened."""
    ts = F.col("event_timestamp")
    upper = (ts <= A.ts_lit(hi)) if hi_inclusive else (ts < A.ts_lit(hi))
    ev = t.events.where((ts >= A.ts_lit(lo)) & upper)
    if EVENT_MONTH in t.events.columns:
        first = None if lo is None else date(lo.year, lo.month, 1)
        last = None
        if hi is not None:
            last = (hi if hi_inclusive else hi - timedelta(microseconds=1)).date()
        ev = ev.where(F.col(EVENT_MONTH).between(A.date_lit(first), A.date_lit(last)))
    return ev


# ------------------------------------------------------- feature adoption

def active_subscriptions(t: Tables, p: Params) -> DataFrame:
    return t.subscriptions.where((F.col("status") == ACTIVE) & open_at(p.as_of))


def feature_usage_active_users(t: Tables, p: Params) -> DataFrame:
    """Distinct (account, product) with an Active subscription open at
    as_of."""
    return active_subscriptions(t, p).select("account_sk", "product_sk").distinct()


def _joinable_pairs(t: Tables, p: Params) -> DataFrame:
    """Active pairs with both keys set: the only ones an equi-join can match.
    Stating the filter makes every use of the pairs the same plan, so the
    subscriptions are scanned and shuffled once per view."""
    return feature_usage_active_users(t, p).where(
        F.col("account_sk").isNotNull() & F.col("product_sk").isNotNull())


def feature_triples(t: Tables, p: Params) -> DataFrame:
    """Distinct (account, product, feature) of feature events, without most of
    those whose pair isn't active: a Bloom filter of the active pairs stands on
    the event scan, so what no pair can match is neither reduced nor shuffled."""
    pairs = ["account_sk", "product_sk"]
    ev = t.events.where(F.col("feature_sk").isNotNull())
    if ("active_pairs", p.as_of) not in t.cache:
        t.cache["active_pairs", p.as_of] = bloom.build(_joinable_pairs(t, p), pairs)
    kept = t.cache["active_pairs", p.as_of]
    if kept is not None:
        ev = ev.where(kept.may_hold(*pairs))
    return ev.select(*pairs, "feature_sk").distinct()


def adopted_triples(t: Tables, p: Params, triples: DataFrame | None = None) -> DataFrame:
    """Distinct (account, product, feature) of feature events by active
    (account, product) pairs; ``triples``: those of all events, if at hand."""
    # Events are reduced to distinct triples first; the active pairs are
    # distinct, so the inner join keeps each triple once (a left-semi join
    # would be moved below the reduction by the optimizer).
    ev = feature_triples(t, p) if triples is None else triples
    return ev.join(_joinable_pairs(t, p), ["account_sk", "product_sk"])


def feature_usage_adopted_users(t: Tables, p: Params, triples: DataFrame | None = None) -> DataFrame:
    """The adopted triples; `feature_users` is the account key, not a
    count, as in the original."""
    return adopted_triples(t, p, triples).select(
        "product_sk", "feature_sk", F.col("account_sk").alias("feature_users"))


def _adoption(t: Tables, p: Params, triples: DataFrame | None) -> DataFrame:
    feat = (adopted_triples(t, p, triples).groupBy("product_sk", "feature_sk")
            .agg(F.count("account_sk").alias("feature_users")))  # the triples are distinct
    # From the same pairs the triples join to (a NULL account is not counted
    # and a NULL product finds no feature row either way): one scan of the
    # subscriptions, whose exchange both branches share.
    # The pairs are distinct, so counting accounts per product is the
    # distinct count.
    users = (_joinable_pairs(t, p).groupBy("product_sk")
             .agg(F.count("account_sk").alias("users_per_product")))
    return feat.join(users, "product_sk")


def feature_adoption_pct(t: Tables, p: Params, triples: DataFrame | None = None) -> DataFrame:
    """E5: feature users / active users per product, in percent, rounded to 2
    places half away from zero on exact decimals (numeric in the original)."""
    num = F.col("feature_users").cast("decimal(20,0)")
    den = F.col("users_per_product").cast("decimal(20,0)")
    return _adoption(t, p, triples).select(
        "product_sk", "feature_sk", "feature_users", "users_per_product",
        F.round(num / den * 100, 2).alias("feature_adoption"))


def adoption_rates(t: Tables, p: Params, triples: DataFrame | None = None) -> DataFrame:
    """E5's ratio as float8, not scaled, not rounded."""
    return _adoption(t, p, triples).select(
        "product_sk", "feature_sk", "feature_users", "users_per_product",
        (F.col("feature_users").cast("double") / F.col("users_per_product")).alias("feature_adoption"))


# ------------------------------------------------------------ stickiness

def stickiness(t: Tables, p: Params) -> DataFrame:
    """DAU/MAU per product at the latest event T.

    Product-use events only (not login/logout/page_view), of contacts and
    accounts present in their dimensions. MAU: distinct contacts from the
    start of T's month up to T; DAU: those from the start of T's day up to T.
    The original's time-of-day tests only restate `event_timestamp <= T`.
    It computes DAU with a correlated subquery per MAU product; DAU events are
    a subset of MAU events, so both are one aggregate with a conditional
    distinct count. A NULL product never matches the correlated equality:
    its stickiness is 0. The original's ORDER BY is not kept by a stored table.
    """
    T = A.latest_event(t)
    month_start = None if T is None else datetime(T.year, T.month, 1)
    day_start = None if T is None else datetime(T.year, T.month, T.day)
    # Reduced map-side to one row per (product, contact, account) before the
    # existence joins; then one aggregate per product.
    ev = (events_between(t, month_start, T, hi_inclusive=True).where(not_navigation())
          .groupBy("product_sk", "contact_sk", "account_sk")
          .agg(F.max(F.col("event_timestamp") >= A.ts_lit(day_start)).alias("today")))
    ev = in_dim(in_dim(ev, t.contacts, "contact_sk"), t.accounts, "account_sk")
    dau = F.count_distinct(F.when(F.col("today"), F.col("contact_sk")))
    agg = ev.groupBy("product_sk").agg(dau.alias("dau"), F.count_distinct("contact_sk").alias("mau"))
    return agg.select(
        "product_sk",
        F.when(F.col("product_sk").isNull(), F.lit(0.0))
        .otherwise(ratio(F.col("dau"), F.col("mau"))).alias("stickiness"))


# ------------------------------------------------------ usage breakdowns

def dim_device(t: Tables, p: Params) -> DataFrame:
    """Distinct device types."""
    return t.events.select("device_type").distinct()


def event_depth(t: Tables, p: Params) -> DataFrame:
    """Product-use events in [depth_start, depth_end] (timestamps, both
    inclusive; the default end is Dec 31 00:00:00, as written in the
    original) per slice: event count (float8) and distinct contacts."""
    ev = (events_between(t, p.depth_start, p.depth_end, hi_inclusive=True).where(not_navigation())
          .groupBy("account_sk", "contact_sk", "product_sk")
          .agg(F.count("event_sk").alias("n")))
    ev = in_dim(ev, t.contacts, "contact_sk")
    return (ev.join(account_attrs(t, *ATTRS), "account_sk")
            .groupBy("product_sk", *ATTRS)
            .agg(F.sum("n").cast("double").alias("events_count"),
                 F.count_distinct("contact_sk").alias("user_count")))


def _feature_use() -> Column:
    return (F.col("event_type") == FEATURE_USE) & F.col("feature_sk").isNotNull()


def adoption_devices(t: Tables, p: Params) -> DataFrame:
    """Per (product, device, feature): distinct contacts with feature_use
    events on the feature, over distinct contacts with any event on the
    (product, device).

    One scan of events: first a hash aggregate to distinct (product, device,
    contact, used feature), then one row per (product, device, contact) with
    its features, exploded into a NULL marker (counts toward the total) plus
    one row per used feature; one count per (product, device, item) gives both
    numbers. NULL contacts make groups but are not counted, as in
    COUNT(DISTINCT).
    """
    keys = ["product_sk", "device_type"]
    per_contact = (t.events
                   .select(*keys, "contact_sk",
                           F.when(_feature_use(), F.col("feature_sk")).alias("f"))
                   .distinct()
                   .groupBy(*keys, "contact_sk").agg(F.collect_list("f").alias("feats")))
    items = F.concat(F.array(F.lit(None).cast("bigint")), F.col("feats"))
    counts = (per_contact
              .select(*keys, F.col("contact_sk").isNotNull().cast("int").alias("c"),
                      F.explode(items).alias("item"))
              .groupBy(*keys, "item").agg(F.sum("c").cast("bigint").alias("n")))
    used = counts.where(F.col("item").isNotNull()).select(
        *keys, F.col("item").alias("feature_sk"), F.col("n").alias("feature_employees_count"))
    total = counts.where(F.col("item").isNull()).select(
        *keys, F.col("n").alias("total_employees_count"))
    return used.join(total, keys).select(
        *keys, "feature_sk", "feature_employees_count", "total_employees_count",
        ratio(F.col("feature_employees_count"), F.col("total_employees_count")).alias("adoption_rate"))


def adoption_products(t: Tables, p: Params) -> DataFrame:
    """Per (product, device, segment): distinct contacts with feature_use
    events over distinct contacts with any event; only groups that have a
    feature_use event (the original's inner join)."""
    ev = (t.events.groupBy("account_sk", "product_sk", "device_type", "contact_sk")
          .agg(F.max(_feature_use()).alias("used")))
    joined = ev.join(account_attrs(t, "segment"), "account_sk")
    keys = ["product_sk", "device_type", "segment"]
    agg = joined.where(F.col("product_sk").isNotNull() & F.col("device_type").isNotNull()
                       & F.col("segment").isNotNull()).groupBy(*keys).agg(
        F.count_distinct(F.when(F.col("used"), F.col("contact_sk"))).alias("product_employees_count"),
        F.count_distinct("contact_sk").alias("total_employees_count"),
        F.max("used").alias("any_used"))
    return agg.where(F.col("any_used")).select(
        "product_sk", "segment", "device_type", "product_employees_count", "total_employees_count",
        ratio(F.col("product_employees_count"), F.col("total_employees_count")).alias("adoption_rate"))


def _december_before(year: int | None) -> tuple[datetime | None, datetime | None]:
    if year is None:
        return (None, None)
    return (datetime(year - 1, 12, 1), datetime(year, 1, 1))


def login_frequency(t: Tables, p: Params) -> DataFrame:
    """Logins per distinct contact in December of the year before the
    latest event's year (half-open month), per product and segment."""
    T = A.latest_event(t)
    lo, hi = _december_before(None if T is None else T.year)
    ev = (events_between(t, lo, hi).where(F.col("event_type") == LOGIN)
          .groupBy("account_sk", "product_sk", "contact_sk")
          .agg(F.count("event_type").alias("n")))
    return (ev.join(account_attrs(t, "segment"), "account_sk")
            .groupBy("product_sk", "segment")
            .agg(ratio(F.sum("n"), F.count_distinct("contact_sk")).alias("login_frequency")))


def product_users_by_country(t: Tables, p: Params) -> DataFrame:
    """Distinct contacts per product, event country and account segment,
    all events, all time."""
    ev = t.events.select("account_sk", "product_sk", "country", "contact_sk").distinct()
    return (ev.join(account_attrs(t, "segment"), "account_sk")
            .groupBy("product_sk", "country", "segment")
            .agg(F.count_distinct("contact_sk").alias("user_count")))


def _page(t: Tables) -> Column:
    """JSON `page` of an event: the typed column of a stored star, which then is
    all of the payload that is read, else parsed from the text."""
    if "shredded" not in t.cache:
        t.cache["shredded"] = t.shredded is not None and t.shredded()
    return F.col(f"{SHREDDED}.value") if t.cache["shredded"] else F.get_json_object("metadata", PAGE_PATH)


def specific_page_usage(t: Tables, p: Params) -> DataFrame:
    """Page views in December of the year before D (the subscription
    anchor, unlike V28), per product and JSON `page` (a missing key is a NULL
    page group), with the product's total. NULL products are dropped by the
    original's join.

    One aggregate by (product, page); the product totals are summed from it
    (one row per product, which AQE broadcasts once measured) and joined back
    on the product, so a product with very many distinct pages is never
    gathered into one task, as a window per product would do.
    """
    d = A.latest_start(t)
    lo, hi = _december_before(None if d is None else d.year)
    pv = events_between(t, lo, hi).where(
        (F.col("event_type") == PAGE_VIEW) & F.col("product_sk").isNotNull()
    ).select("product_sk", "event_type",
             _page(t).alias("specific_page"))
    per_page = pv.groupBy("product_sk", "specific_page").agg(
        F.count("event_type").alias("specific_page_views"))
    totals = per_page.groupBy("product_sk").agg(
        F.sum("specific_page_views").alias("total_page_views"))
    return per_page.join(totals, "product_sk").select(
        "product_sk", "total_page_views", "specific_page", "specific_page_views")
