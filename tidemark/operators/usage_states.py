"""The usage views from mergeable states instead of events.

A state is a table that adds up: built from any part of the events, united with
the states of the other parts and merged by its keys, it equals the state of
all events. Counts add; sets of contacts are exact bitmaps (contacts have
numbers, a row holds the bits of 64 of them in a long) and add by OR, so distinct
counts over months, devices or slices come from the stored bits alone. A row
is never larger than that of a few contacts that it holds, however few of its
neighbours they have, and hash aggregates take it without sorting.

``STATES`` holds how each state is made from events; ``VIEWS`` how the views
read them. Where plans.incremental keeps the states of all event files, a view
reads no event (V25 reads those of the days that its window cuts).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import anchors as A
from tidemark.functions.fixed import FEATURE_USE, LOGIN, PAGE_PATH, PAGE_VIEW
from tidemark.functions.joins import account_attrs, in_dim
from tidemark.functions.predicates import ATTRS, not_navigation, ratio
from tidemark.operators import usage
from tidemark.params import Params
from tidemark.sources.star import Tables

NUMBER = "contact_no"
WORD_SHIFT = 6           # a word holds the bits of 64 contacts


def bucket_of(number: str) -> Column:
    return F.shiftright(number, WORD_SHIFT)


def bit_of(number: str) -> Column:
    at = F.col(number).bitwiseAND(F.lit((1 << WORD_SHIFT) - 1).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def any_bits(c) -> Column:
    """The words' OR, 0 where there is none."""
    return F.coalesce(F.bit_or(c), F.lit(0).cast("long"))


def contacts(c: str) -> Column:
    """Contacts of a group's words, each bucket once."""
    return F.sum(F.bit_count(c).cast("long")).cast("bigint")


def _used() -> Column:
    return (F.col("event_type") == FEATURE_USE) & F.col("feature_sk").isNotNull()


@dataclass(frozen=True)
class State:
    """keys; sums (columns that add); bits (bitmap columns of contacts, by bucket);
    flags (columns that add by OR); the dimension tables it joins; and how rows
    of events become rows of (keys, sums, flags, and for bits a condition each)."""

    keys: tuple[str, ...]
    make: Callable[[DataFrame, Tables], DataFrame]
    sums: tuple[str, ...] = ()
    bits: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    dims: tuple[str, ...] = ()

    def group(self) -> list[str]:
        return [*self.keys, *(["bucket"] if self.bits else [])]

    def merged(self, states: DataFrame, keys=None) -> DataFrame:
        """States united: by their own keys, or by fewer of them (the rest adds up)."""
        by = list(keys if keys is not None else self.keys) + (["bucket"] if self.bits else [])
        aggs = ([F.sum(c).alias(c) for c in self.sums] + [any_bits(c).alias(c) for c in self.bits]
                + [F.max(c).alias(c) for c in self.flags])
        return states.groupBy(*by).agg(*aggs) if aggs else states.select(*by).distinct()

    def build(self, events: DataFrame, t: Tables, numbers: DataFrame | None) -> DataFrame:
        """The state of these events, by ``extra`` columns of events too (``part``).
        Rows are reduced to one per key and contact before the contacts get their numbers."""
        rows = self.make(events, t)
        if not self.bits:
            return rows
        rows = rows.join(numbers, "contact_sk", "left").withColumn("bucket", bucket_of(NUMBER))
        bit = bit_of(NUMBER)
        return rows.groupBy("part", *self.group()).agg(
            *[F.sum(c).alias(c) for c in self.sums],
            *[any_bits(F.when(F.col(f"is_{c}"), bit)).alias(c) for c in self.bits],
            *[F.max(c).alias(c) for c in self.flags])


def contacts_in(states: DataFrame, keys, **counts: str) -> DataFrame:
    """Distinct contacts per key: ``counts`` gives a bitmap column for each name."""
    return states.groupBy(*keys).agg(*[contacts(c).alias(n) for n, c in counts.items()])


def _devices(ev: DataFrame, t: Tables) -> DataFrame:
    keys = ["part", "product_sk", "device_type", "contact_sk"]
    seen = ev.select(*keys, F.when(_used(), F.col("feature_sk")).alias("f")).distinct()
    any_ = seen.select(*keys, F.lit(None).cast("bigint").alias("feature_sk")).distinct()
    rows = any_.unionByName(seen.where("f IS NOT NULL").withColumnRenamed("f", "feature_sk"))
    return rows.withColumn("is_users", F.lit(True))


def _segments(ev: DataFrame, t: Tables) -> DataFrame:
    rows = (ev.groupBy("part", "account_sk", "product_sk", "device_type", "contact_sk")
            .agg(F.coalesce(F.max(_used()), F.lit(False)).alias("any_used")))
    return rows.join(account_attrs(t, "segment"), "account_sk").select(
        "part", "product_sk", "device_type", "segment", "contact_sk", "any_used",
        F.col("any_used").alias("is_used"), F.lit(True).alias("is_users"))


def _countries(ev: DataFrame, t: Tables) -> DataFrame:
    rows = ev.select("part", "account_sk", "product_sk", "country", "contact_sk").distinct()
    return rows.join(account_attrs(t, "segment"), "account_sk").drop("account_sk").withColumn("is_users", F.lit(True))


def _daily(ev: DataFrame, t: Tables) -> DataFrame:
    rows = (ev.where(not_navigation())
            .groupBy("part", F.to_date("event_timestamp").alias("day"), "product_sk", "contact_sk", "account_sk")
            .agg(F.count("event_sk").alias("n")))
    return in_dim(rows, t.contacts, "contact_sk").join(account_attrs(t, *ATTRS), "account_sk").drop(
        "account_sk").withColumn("is_users", F.lit(True))


def _month(ts: str) -> Column:
    return F.make_date(F.year(ts), F.month(ts), F.lit(1))


def _logins(ev: DataFrame, t: Tables) -> DataFrame:
    rows = (ev.where(F.col("event_type") == LOGIN)
            .groupBy("part", _month("event_timestamp").alias("month"), "account_sk", "product_sk", "contact_sk")
            .agg(F.count("event_type").alias("n")))
    return rows.join(account_attrs(t, "segment"), "account_sk").drop("account_sk").withColumn("is_users", F.lit(True))


def _pages(ev: DataFrame, t: Tables) -> DataFrame:
    rows = ev.where((F.col("event_type") == PAGE_VIEW) & F.col("product_sk").isNotNull())
    return rows.groupBy("part", _month("event_timestamp").alias("month"), "product_sk",
                        F.get_json_object("metadata", PAGE_PATH).alias("page")).agg(F.count("event_type").alias("n"))


def _triples(ev: DataFrame, t: Tables) -> DataFrame:
    return ev.where(F.col("feature_sk").isNotNull()).select("part", "account_sk", "product_sk", "feature_sk").distinct()


STATES: dict[str, State] = {
    "devices": State(("product_sk", "device_type", "feature_sk"), _devices, bits=("users",)),
    "segments": State(("product_sk", "device_type", "segment"), _segments, bits=("used", "users"), flags=("any_used",),
                      dims=("accounts",)),
    "countries": State(("product_sk", "country", "segment"), _countries, bits=("users",), dims=("accounts",)),
    "daily": State(("day", "product_sk", *ATTRS), _daily, sums=("n",), bits=("users",), dims=("accounts", "contacts")),
    "logins": State(("month", "product_sk", "segment"), _logins, sums=("n",), bits=("users",), dims=("accounts",)),
    "pages": State(("month", "product_sk", "page"), _pages, sums=("n",)),
    "triples": State(("account_sk", "product_sk", "feature_sk"), _triples),
}


# ------------------------------------------------------------------- views
# ``states(name)`` gives the united, unmerged rows of a state.

def dim_device(t: Tables, p: Params, states) -> DataFrame:
    """V22 from the device bitmaps' keys."""
    return states("devices").select("device_type").distinct()


def adoption_devices(t: Tables, p: Params, states) -> DataFrame:
    """A feature's contacts over all contacts of the product and device."""
    keys = ["product_sk", "device_type"]
    users = contacts_in(STATES["devices"].merged(states("devices")), [*keys, "feature_sk"], n="users")
    used = users.where("feature_sk IS NOT NULL").withColumnRenamed("n", "feature_employees_count")
    total = users.where("feature_sk IS NULL").select(*keys, F.col("n").alias("total_employees_count"))
    return used.join(total, keys).select(
        *keys, "feature_sk", "feature_employees_count", "total_employees_count",
        ratio(F.col("feature_employees_count"), F.col("total_employees_count")).alias("adoption_rate"))


def kpi_device_adoption(t: Tables, p: Params, states) -> DataFrame:
    """K14 from V27's bits: OR over products and features. Slicers on the product
    choose bits; one on an account attribute needs the events."""
    if set(p.slicers) - {"product_sk"}:
        return None
    rows = states("devices")
    for c, value in p.slicers.items():
        rows = rows.where(F.col(c) == F.lit(value))
    rows = rows.select("device_type", "bucket", "users", F.col("feature_sk").isNotNull().alias("used"))
    bits = rows.groupBy("device_type", "bucket").agg(
        any_bits(F.when(F.col("used"), F.col("users"))).alias("used"),
        any_bits(F.when(~F.col("used"), F.col("users"))).alias("users"))
    agg = contacts_in(bits, ["device_type"], feature_users="used", total_users="users")
    return agg.select("device_type", "feature_users", "total_users",
                      ratio(F.col("feature_users"), F.col("total_users")).alias("adoption_rate"))


def adoption_products(t: Tables, p: Params, states) -> DataFrame:
    """Contacts with feature use over all contacts, where there is any use."""
    keys = ["product_sk", "device_type", "segment"]
    rows = states("segments").where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    merged = STATES["segments"].merged(rows)
    agg = merged.groupBy(*keys).agg(
        contacts("used").alias("product_employees_count"),
        contacts("users").alias("total_employees_count"), F.max("any_used").alias("any_used"))
    return agg.where("any_used").select(
        "product_sk", "segment", "device_type", "product_employees_count", "total_employees_count",
        ratio(F.col("product_employees_count"), F.col("total_employees_count")).alias("adoption_rate"))


def product_users_by_country(t: Tables, p: Params, states) -> DataFrame:
    """V29."""
    keys = ["product_sk", "country", "segment"]
    return contacts_in(STATES["countries"].merged(states("countries")), keys, user_count="users")


def stickiness(t: Tables, p: Params, states) -> DataFrame:
    """T is the latest event, so T's month and day up to T are the whole
    days that the states hold."""
    T = A.latest_event(t)
    first = None if T is None else date(T.year, T.month, 1)
    today = F.col("day") == A.date_lit(None if T is None else T.date())
    rows = states("daily").where(F.col("day").between(A.date_lit(first), A.date_lit(None if T is None else T.date())))
    bits = rows.groupBy("product_sk", "bucket").agg(
        any_bits(F.when(today, F.col("users"))).alias("today"), any_bits("users").alias("month"))
    agg = contacts_in(bits, ["product_sk"], dau="today", mau="month")
    return agg.select("product_sk", F.when(F.col("product_sk").isNull(), F.lit(0.0))
                      .otherwise(ratio(F.col("dau"), F.col("mau"))).alias("stickiness"))


def whole_days(lo: datetime, hi: datetime) -> tuple[date, date, list[tuple[datetime, datetime]]]:
    """The days that [lo, hi] holds whole (none if the first is past the last) and
    the ranges that are left of it, both ends included."""
    end = datetime.combine(hi.date(), time.max)
    first = lo.date() if lo.time() == time.min else lo.date() + timedelta(days=1)
    last = hi.date() if hi >= end else hi.date() - timedelta(days=1)
    if first > last:
        return first, last, [(lo, hi)] if lo <= hi else []
    cut = []
    if lo.date() < first:
        cut.append((lo, datetime.combine(lo.date(), time.max)))
    if last < hi.date():
        cut.append((datetime.combine(hi.date(), time.min), hi))
    return first, last, cut


def event_depth(t: Tables, p: Params, states) -> DataFrame:
    """Whole days of the window from the states, the days it cuts from the
    events, with the contacts' stored numbers."""
    first, last, cut = whole_days(p.depth_start, p.depth_end)
    state = STATES["daily"]
    keys = ["product_sk", *ATTRS]
    columns = [*keys, "bucket", "n", "users"]
    rows = states("daily").where(F.col("day").between(A.date_lit(first), A.date_lit(last))).select(*columns)
    for lo, hi in cut:
        ev = usage.events_between(t, lo, hi, hi_inclusive=True).withColumn("part", F.lit(""))
        rows = rows.unionByName(state.build(ev, t, states.numbers()).select(*columns))
    merged = state.merged(rows, keys)
    return merged.groupBy(*keys).agg(F.sum("n").cast("double").alias("events_count"),
                                     contacts("users").alias("user_count"))


def login_frequency(t: Tables, p: Params, states) -> DataFrame:
    """V28."""
    T = A.latest_event(t)
    month = None if T is None else date(T.year - 1, 12, 1)
    keys = ["product_sk", "segment"]
    merged = STATES["logins"].merged(states("logins").where(F.col("month") == A.date_lit(month)), keys)
    agg = merged.groupBy(*keys).agg(F.sum("n").alias("n"), contacts("users").alias("users"))
    return agg.select(*keys, ratio(F.col("n"), F.col("users")).alias("login_frequency"))


def specific_page_usage(t: Tables, p: Params, states) -> DataFrame:
    """V30."""
    d = A.latest_start(t)
    rows = states("pages").where(F.col("month") == A.date_lit(None if d is None else date(d.year - 1, 12, 1)))
    per_page = rows.groupBy("product_sk", F.col("page").alias("specific_page")).agg(
        F.sum("n").cast("bigint").alias("specific_page_views"))
    totals = per_page.groupBy("product_sk").agg(F.sum("specific_page_views").alias("total_page_views"))
    return per_page.join(totals, "product_sk").select(
        "product_sk", "total_page_views", "specific_page", "specific_page_views")


def _triples_of(states) -> DataFrame:
    return states("triples").select("account_sk", "product_sk", "feature_sk").distinct()


def feature_usage_adopted_users(t: Tables, p: Params, states) -> DataFrame:
    """V24."""
    return usage.feature_usage_adopted_users(t, p, _triples_of(states))


def feature_adoption_pct(t: Tables, p: Params, states) -> DataFrame:
    """E5."""
    return usage.feature_adoption_pct(t, p, _triples_of(states))


def adoption_rates(t: Tables, p: Params, states) -> DataFrame:
    """V26."""
    return usage.adoption_rates(t, p, _triples_of(states))


# View -> (how it reads the states, which ones).
VIEWS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "dim_device": (dim_device, ("devices",)),
    "adoption_devices": (adoption_devices, ("devices",)),
    "kpi_device_adoption": (kpi_device_adoption, ("devices",)),
    "adoption_products": (adoption_products, ("segments",)),
    "product_users_by_country": (product_users_by_country, ("countries",)),
    "stickiness": (stickiness, ("daily",)),
    "event_depth": (event_depth, ("daily",)),
    "login_frequency": (login_frequency, ("logins",)),
    "specific_page_usage": (specific_page_usage, ("pages",)),
    "feature_usage_adopted_users": (feature_usage_adopted_users, ("triples",)),
    "feature_adoption_pct": (feature_adoption_pct, ("triples",)),
    "adoption_rates": (adoption_rates, ("triples",)),
}
