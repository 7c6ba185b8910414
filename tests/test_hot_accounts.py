"""Row-level views with a third of all subscriptions on one account: the join's
partitions are even at default AQE thresholds."""

from __future__ import annotations

import os
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from edge_star import write_star
from oracle.compare import norm
from tidemark.functions import joins
from tidemark.params import Params
from tidemark.plans import materialize, registry
from tidemark.sources.star import read_star

ROW_LEVEL = ["mrr_arr_snapshot", "fact_mrr_accounts", "fact_previous_month_net_mrr", "previous_year_mrr",
             "previous_mrr_for_nrr", "previous_window_mrr_snapshot", "renewals_due"]
PARTS = 16


def multiset(df):
    cols = sorted(df.columns)
    return Counter(tuple(norm(r[c], True) for c in cols) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def star(spark, scratch):
    src = write_star(spark, os.path.join(scratch, "hot-src"))
    n = 60_000
    i = F.col("id")
    date = lambda days: F.date_add(F.lit("2023-01-01").cast("date"), days.cast("int"))
    subs = spark.range(n).select(
        i.alias("subscription_id"),
        # A third on account 1, a tenth on account 2, a NULL now and then.
        F.when(i % 3 == 0, 1).when(i % 10 == 1, 2).when(i % 500 == 7, F.lit(None)).otherwise(10 + i % 5000).cast("long").alias("account_sk"),
        (1 + i % 4).alias("product_sk"), (1 + i % 3).alias("plan_sk"), date(i % 900).alias("start_date"),
        F.when(i % 5 == 0, date(i % 900 + 200)).alias("end_date"), F.when(i % 7 == 0, "Cancelled").otherwise("Active").alias("status"),
        F.date_add(F.lit("2025-08-01").cast("date"), (i % 100).cast("int")).alias("renewal_date"),
        (i % 997).cast("decimal(12,2)").alias("net_mrr_usd"), i.alias("seat_commit"), i.alias("seat_provisioned"), (i % 2 == 0).alias("is_auto_renew"))
    src._tables["subscriptions"] = subs
    accounts = spark.range(5100).select(
        F.col("id").alias("account_sk"), F.lit("S").alias("segment"), F.lit("I").alias("industry"), F.lit("US").alias("hq_country"),
        F.lit("2024-01-01").cast("date").alias("created_at"))
    src._tables["accounts"] = accounts
    out = os.path.join(scratch, "hot-star")
    materialize.write_star(src, out)
    return out


@pytest.fixture
def sixteen(spark):
    settings = {"spark.sql.shuffle.partitions": str(PARTS), "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest_over_median(df) -> float:
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) / median(sizes)


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_partitions_are_even(spark, star, sixteen, monkeypatch, name):
    p = Params()
    plain = registry.ALL[name](read_star(spark, star), p)
    monkeypatch.setattr(joins, "HOT_BYTES", 0)
    t = read_star(spark, star)
    dealt = registry.ALL[name](t, p)
    if name != "renewals_due":      # whose rows then go to their products, a few keys that AQE broadcasts
        assert largest_over_median(plain) > 3         # what the hot account does without pieces
        assert largest_over_median(dealt) < 2.5
    assert "_piece" in dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.schema == plain.schema
    if name in ("mrr_arr_snapshot", "renewals_due"):
        assert multiset(dealt) == multiset(plain)
    else:
        assert dealt.count() == plain.count()


def test_pieces_follow_the_counts(spark, star, sixteen, monkeypatch):
    assert joins.hot_accounts(read_star(spark, star)) == {}         # a small fact is not counted
    monkeypatch.setattr(joins, "HOT_BYTES", 0)
    # 20,000 and 4,000 rows where a partition has 3,750.
    assert joins.hot_accounts(read_star(spark, star)) == {32: [1], 8: [2]}
    monkeypatch.setattr(joins, "HOT_TASKS", 2)
    assert joins.hot_accounts(read_star(spark, star)) == {32: [1]}
