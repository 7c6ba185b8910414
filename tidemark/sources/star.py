"""The star schema the analytics read, derived by Spark from the raw tables.

The report SQL queries a subscription star schema (facts: subscriptions,
usage events; dimensions: accounts, contacts, products, plans, calendar). The
driver's data is TPC-H shaped, so each star table is a projection of a whole
raw table (FIXTURES.md has the rules); nothing is subset or sampled, so the
work grows with the inputs.

All derivations are per-row expressions except ``dim_products`` (one small
aggregate over ``part``); nothing shuffles a fact table here.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import paths as files
from tidemark.sources import zones
from tidemark.sources.raw import read_raw, table_path

# Fixed values of the derivation (FIXTURES.md): the calendar range, the day
# shift that moves order dates into the subscription era, the renewal base,
# the number of products, and the raw-to-product event-type mapping.
CALENDAR_START = date(2019, 1, 1)
ACCOUNT_EPOCH = date(2019, 1, 1)
START_SHIFT_DAYS = 8766
RENEWAL_BASE = date(2025, 6, 2)
N_PRODUCTS = 8
N_PLANS = 5
EVENT_TYPE_MAP = {
    "view": "page_view",
    "click": "feature_use",
    "signup": "login",
    "error": "logout",
}
EVENT_TYPE_OTHER = "export"
DEVICES = ["Web", "iOS", "Android"]


# The star tables: attribute name -> (table name, schema).
STAR_TABLES: dict[str, tuple[str, str]] = {
    "accounts": ("dim_accounts",
                 "account_sk BIGINT, segment STRING, industry STRING, hq_country STRING, created_at DATE"),
    "subscriptions": ("fact_subscriptions",
                      "subscription_id BIGINT, account_sk BIGINT, product_sk BIGINT, plan_sk BIGINT, "
                      "start_date DATE, end_date DATE, status STRING, renewal_date DATE, "
                      "net_mrr_usd DECIMAL(12,2), seat_commit BIGINT, seat_provisioned BIGINT, "
                      "is_auto_renew BOOLEAN"),
    "events": ("fact_events",
               "event_sk BIGINT, contact_sk BIGINT, account_sk BIGINT, product_sk BIGINT, "
               "feature_sk BIGINT, event_type STRING, device_type STRING, country STRING, "
               "event_timestamp TIMESTAMP_NTZ, metadata STRING"),
    "contacts": ("dim_contacts", "contact_sk BIGINT, account_sk BIGINT"),
    "products": ("dim_products", "product_sk BIGINT, product_name STRING"),
    "plans": ("dim_plans", "plan_sk BIGINT, plan_name STRING"),
    "dates": ("dim_date", "date DATE"),
}


# Partition column of a subscription fact stored by plans.materialize: "=" and the status.
STATUS_PART = "status_part"


class Tables:
    """The seven star tables plus a per-load cache of anchor scalars and size
    checks, so a batch of views computes each once.

    Each table is given as a DataFrame or as a zero-argument function building
    one; functions run on first access, so a view only plans the tables it
    reads.
    """

    NAMES = ("accounts", "subscriptions", "events", "contacts", "products", "plans", "dates")

    def __init__(self, spark: SparkSession | None = None, **tables):
        unknown = set(tables) - set(self.NAMES)
        if unknown:
            raise TypeError(f"unknown star tables: {sorted(unknown)}")
        self._spark = spark
        self._tables = dict(tables)
        self.cache: dict = {}
        # Folder the tables come from, if one.
        self.source: str | None = None
        # () -> (first, last) day of a calendar known to hold every day between.
        self.calendar_span = None
        # table -> (MIN, MAX) of its zoned column (sources.zones), on a stored star.
        self.zone_bounds = None
        # () -> whether all events hold the shredded payload (zones.SHREDDED).
        self.shredded = None
        # attribute -> path that holds its rows.
        self.paths: dict[str, str] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in Tables.NAMES:
            value = self._tables[name]
            if not isinstance(value, DataFrame):
                value = self._tables[name] = value()
            return value
        raise AttributeError(name)

    def input_bytes(self, attr: str) -> int | None:
        """Stored bytes that a table is read from, if known."""
        return files.size(self.spark, self.paths[attr]) if attr in self.paths else None

    def version(self) -> str:
        """Changes when the input files do; unique if there is no one folder."""
        return files.version(self.spark, self.source) if self.source else uuid.uuid4().hex

    @property
    def spark(self) -> SparkSession:
        return self._spark or self.accounts.sparkSession


def _days(n: Column) -> Column:
    return n.cast("int")


def dim_accounts(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        key.alias("account_sk"),
        F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit("IND_"), (key % 7).cast("string")).alias("industry"),
        F.col("n_name").alias("hq_country"),
        F.date_add(F.lit(ACCOUNT_EPOCH), _days(key * 37 % 2400)).alias("created_at"),
    )


def fact_subscriptions(orders: DataFrame) -> DataFrame:
    okey = F.col("o_orderkey")
    start = F.date_add(F.to_date("o_orderdate"), START_SHIFT_DAYS)
    status = (
        F.when((F.col("o_orderstatus") == "F") | (F.col("o_custkey") % 6 == 0), "Cancelled")
        .when((F.col("o_orderstatus") == "O") & (okey % 4 == 0), "Paused")
        .otherwise("Active")
    )
    seat_commit = F.lit(5) + okey % 96
    return (
        orders.select(okey, "o_custkey", "o_totalprice", start.alias("start_date"), status.alias("status"))
        .select(
            okey.alias("subscription_id"),
            F.col("o_custkey").alias("account_sk"),
            (okey % N_PRODUCTS).alias("product_sk"),
            (okey % N_PLANS).alias("plan_sk"),
            "start_date",
            F.when(F.col("status") == "Cancelled",
                   F.date_add("start_date", _days(30 + okey % 700)))
            .when((F.col("status") == "Active") & (okey % 7 == 0),
                  F.date_add("start_date", 1095))
            .alias("end_date"),
            "status",
            F.date_add(F.lit(RENEWAL_BASE), _days(okey % 365)).alias("renewal_date"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("net_mrr_usd"),
            seat_commit.alias("seat_commit"),
            (seat_commit - okey % 6).alias("seat_provisioned"),
            (okey % 10 != 0).alias("is_auto_renew"),
        )
    )


def fact_events(events: DataFrame) -> DataFrame:
    eid, uid, raw_type = F.col("event_id"), F.col("user_id"), F.col("event_type")
    contact = uid * 10 + eid % 10
    event_type = F.lit(EVENT_TYPE_OTHER)
    for raw, mapped in reversed(list(EVENT_TYPE_MAP.items())):
        event_type = F.when(raw_type == raw, mapped).otherwise(event_type)
    device = F.when(eid % 3 == 0, DEVICES[0]).when(eid % 3 == 1, DEVICES[1]).otherwise(DEVICES[2])
    shift = F.make_dt_interval(days=_days(320 + (uid % 9) * 30))
    return events.select(
        eid.alias("event_sk"),
        contact.alias("contact_sk"),
        contact.alias("account_sk"),
        (eid % N_PRODUCTS).alias("product_sk"),
        F.when((raw_type == "click") & (eid % 9 != 0), eid % 20).alias("feature_sk"),
        event_type.alias("event_type"),
        device.alias("device_type"),
        F.concat(F.lit("NATION_"), (eid % 25).cast("string")).alias("country"),
        (F.col("ts").cast("timestamp_ntz") + shift).alias("event_timestamp"),
        F.concat(F.lit('{"page": "page_'), (eid % 12).cast("string"), F.lit('"}')).alias("metadata"),
    )


def dim_products(part: DataFrame) -> DataFrame:
    # One row per product class; the name is that of the class's lowest part.
    # The lowest keys (at most N_PRODUCTS, from a hash aggregate over the key
    # column) are resolved once, as anchors are, and the scan filters on them.
    sk = F.col("p_partkey") % N_PRODUCTS
    lowest = [r[0] for r in part.groupBy(sk.alias("sk")).agg(F.min("p_partkey")).select("min(p_partkey)").collect()]
    return part.where(F.col("p_partkey").isin([k for k in lowest if k is not None])).select(
        sk.alias("product_sk"), F.col("p_name").alias("product_name"))


def dim_plans(region: DataFrame) -> DataFrame:
    return region.select(
        F.col("r_regionkey").cast("bigint").alias("plan_sk"), F.col("r_name").alias("plan_name")
    )


def dim_contacts(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("contact_sk"), F.col("c_custkey").alias("account_sk")
    )


def dim_date(spark: SparkSession, start: date, end: date) -> DataFrame:
    n_days = (end - start).days + 1
    return spark.range(n_days).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))


def whole_years(t: Tables):
    """The calendar's span: whole years up to that of the latest subscription
    start or account creation (looked up when first asked for)."""
    def span() -> tuple[date, date]:
        from tidemark.functions.anchors import latest_created, latest_start

        last = max((d for d in (latest_start(t), latest_created(t)) if d), default=CALENDAR_START)
        return (CALENDAR_START, date(last.year, 12, 31))

    return span


def load_star(spark: SparkSession, sf_dir: str) -> Tables:
    """The star over the raw tables in ``sf_dir`` (lazy: nothing is read or
    planned until a table is used)."""
    def read(name: str) -> DataFrame:
        return read_raw(spark, sf_dir, name)

    t = Tables(
        spark,
        accounts=lambda: dim_accounts(read("customer"), read("nation")),
        subscriptions=lambda: fact_subscriptions(read("orders")),
        events=lambda: fact_events(read("events")),
        contacts=lambda: dim_contacts(read("customer")),
        products=lambda: dim_products(read("part")),
        plans=lambda: dim_plans(read("region")),
        dates=lambda: dim_date(spark, *t.calendar_span()),
    )

    t.calendar_span = whole_years(t)
    t.source = sf_dir
    t.paths = {attr: table_path(sf_dir, raw) for attr, raw in
               (("accounts", "customer"), ("subscriptions", "orders"), ("events", "events"), ("contacts", "customer"))}
    return t


def read_star(spark: SparkSession, star_dir: str) -> Tables:
    """A star already stored as parquet, one folder per table named as in the
    report SQL (``dim_accounts``, ``fact_subscriptions``, ...)."""
    def reader(table: str, schema: str):
        path = f"{star_dir.rstrip('/')}/{table}"

        def read() -> DataFrame:
            if table == "fact_subscriptions" and STATUS_PART in spark.read.parquet(path).columns:
                own = spark.read.schema(schema.replace("status STRING", f"{STATUS_PART} STRING")).parquet(path)
                # A filter on this expression of the partition column prunes partitions.
                own = own.withColumn("status", F.expr(f"substring({STATUS_PART}, 2)"))
                return own.select(*[c.split()[0] for c in schema.replace("(12,2)", "").split(", ")])
            if table == "fact_events" and zones.has_map(spark, star_dir):
                return spark.read.schema(f"{schema}, {zones.SHREDDED} {zones.SHREDDED_TYPE}").parquet(path)
            return spark.read.schema(schema).parquet(path)
        return read

    t = Tables(spark, **{attr: reader(table, schema) for attr, (table, schema) in STAR_TABLES.items()})
    t.source = star_dir
    t.paths = {attr: f"{star_dir.rstrip('/')}/{table}" for attr, (table, _) in STAR_TABLES.items()}
    if zones.has_map(spark, star_dir):
        t.zone_bounds = lambda table: zones.bounds(spark, star_dir, table)
        t.shredded = lambda: zones.shredded(spark, star_dir)
    return t
