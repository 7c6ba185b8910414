"""The plain views as SQL: live anchors and date, nothing stored."""

from __future__ import annotations

import os
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from edge_star import SUBS, write_star
from oracle.compare import norm
from tidemark.params import Params
from tidemark.plans import catalog, materialize, plain_views, registry
from tidemark.sources import zones
from tidemark.sources.star import read_star


def multiset(df):
    cols = sorted(df.columns)
    return Counter(tuple(norm(r[c], True) for c in cols) for r in df.select(*cols).collect())


@pytest.fixture
def star(spark, scratch, request):
    # Renewals around the reader's date.
    today = date.today()
    subs = [(*s[:7], today + timedelta(days=i * 12 - 30), *s[8:]) for i, s in enumerate(SUBS)]
    subs += [(200 + k, 1, 1, 1, date(2024, 1, 1), None, "Active", today + timedelta(days=d), *SUBS[0][8:])
             for k, d in enumerate((-1, 0, 90, 91))]
    src = write_star(spark, os.path.join(scratch, "plain-src"), {"subscriptions": subs})
    out = os.path.join(scratch, "plain-" + "".join(c for c in request.node.name if c.isalnum()))
    materialize.write_star(src, out)
    return out


def later(spark, star):
    """Subscriptions a year after those of the star."""
    rows = read_star(spark, star).subscriptions.where("subscription_id IS NOT NULL").select(
        "*", F.concat(F.lit("="), "status").alias("status_part")).drop("status")
    rows = rows.withColumn("subscription_id", F.col("subscription_id") + 9000).withColumn(
        "start_date", F.add_months("start_date", 12))
    return spark.createDataFrame(rows.collect(), rows.schema)


@pytest.mark.parametrize("anchors", ["scan", "zones"])
def test_views_equal_the_operators(spark, star, anchors):
    names = plain_views.create(spark, star, prefix=f"pv_{anchors}_", anchors=anchors)
    assert [n.removeprefix(f"pv_{anchors}_") for n in names] == list(plain_views.PLAIN)
    t, p = read_star(spark, star), Params(as_of=date.today())
    for name in plain_views.PLAIN:
        got = spark.sql(f"SELECT * FROM pv_{anchors}_{name}")
        assert got.schema.simpleString() == registry.ALL[name](t, p).schema.simpleString()
        assert multiset(got) == multiset(registry.ALL[name](t, p)) and got.count() > 0


def test_a_view_shows_what_arrives_after_it(spark, star):
    plain_views.create(spark, star, prefix="live_")
    plain_views.create(spark, star, prefix="zoned_", anchors="zones")
    read = lambda: {n: multiset(spark.sql(f"SELECT * FROM live_{n}")) for n in plain_views.PLAIN}
    before = read()
    more = later(spark, star)
    more.write.mode("append").partitionBy("status_part").parquet(f"{star}/fact_subscriptions")
    after = read()
    t = read_star(spark, star)
    for name in plain_views.PLAIN:
        assert after[name] == multiset(registry.ALL[name](t, Params(as_of=date.today()))) != before[name]
    # The zoned view's window follows once the map knows the files.
    zones.refresh(spark, star)
    assert multiset(spark.sql("SELECT * FROM zoned_monthwise_cancelled")) == after["monthwise_cancelled"]


def test_catalog_views(spark, star):
    spark.sql("CREATE DATABASE IF NOT EXISTS plain_test")
    spark.sql("USE plain_test")
    try:
        plain_views.create(spark, star, temporary=False)
        assert {r.viewName for r in spark.sql("SHOW VIEWS IN plain_test").collect() if not r.isTemporary} == set(plain_views.PLAIN)
        t = read_star(spark, star)
        assert multiset(spark.table("plain_test.monthwise_cancelled")) == multiset(registry.ALL["monthwise_cancelled"](t, Params()))
    finally:
        spark.sql("USE default")
        for name in plain_views.PLAIN:
            spark.sql(f"DROP VIEW IF EXISTS plain_test.{name}")
        spark.sql("DROP DATABASE plain_test")


def scans(spark, df):
    """(location, rows out, plan text) of every file scan that ran."""
    df.collect()
    out, plan = [], df._jdf.queryExecution().executedPlan()

    def walk(node):
        if node.nodeName().startswith("Scan parquet"):
            rows = node.metrics().apply("numOutputRows").value()
            out.append((rows, node.toString()))
        for side in (node.children(), node.subqueries()):
            for i in range(side.size()):
                child = side.apply(i)
                walk(child.child() if child.getClass().getSimpleName() == "SubqueryExec" else child)

    walk(plan)
    return out


def test_anchor_prunes_the_stored_scan(spark, scratch):
    """Each bound is one subquery whose value reaches the scan as a filter: of a
    long history only the cohort's row groups are read."""
    src = os.path.join(scratch, "prune-src")
    subs = [(i, 1, 1, 1, date(2015, 1, 1) + timedelta(days=i % 4000), None, "Active", date(2025, 8, 1), *SUBS[0][8:])
            for i in range(20_000)]
    write_star(spark, src, {"subscriptions": subs})
    t = read_star(spark, src)
    star = os.path.join(scratch, "prune-star")
    materialize.write_star(t, star)
    # One file a year, as a fact in ranges of its start date has.
    held = f"{star}/fact_subscriptions"
    spark.read.parquet(held).repartitionByRange(12, "start_date").write.partitionBy("status_part").parquet(held + "-ranged")
    os.rename(held, held + "-old")
    os.rename(held + "-ranged", held)
    plain_views.create(spark, star, prefix="pruned_")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = scans(spark, spark.sql("SELECT * FROM pruned_monthwise_cancelled"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    main = [(n, text) for n, text in found if "end_date" in text]
    assert len(main) == 1 and "ubquery" in main[0][1]
    in_year = sum(s[4].year == max(x[4] for x in subs).year - 1 for s in subs)
    assert in_year <= main[0][0] < 0.4 * len(subs)


def test_build_stores_none_of_the_three(spark, star, scratch):
    out = os.path.join(scratch, "plain-build")
    paths = materialize.build_all(read_star(spark, star), Params(), out, names=["active_users", *plain_views.PLAIN])
    assert set(paths) == {"active_users"}
    run = materialize.current(spark, out)
    assert os.listdir(os.path.join(run, "views")) == ["active_users"]
    names = catalog.register_stored(spark, run, prefix="built_")
    assert set(names) == {f"built_{n}" for n in ("active_users", *plain_views.PLAIN)}
    before = multiset(spark.sql("SELECT * FROM built_monthwise_cancelled"))
    later(spark, f"{run}/star").write.mode("append").partitionBy("status_part").parquet(f"{run}/star/fact_subscriptions")
    assert multiset(spark.sql("SELECT * FROM built_monthwise_cancelled")) != before
