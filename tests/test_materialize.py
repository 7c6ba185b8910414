"""build_all: the stored star and views equal the in-place computation."""

from __future__ import annotations

import os
from collections import Counter
from datetime import date

import pytest

from edge_star import write_star
from oracle.compare import norm
from tidemark.params import Params
from tidemark.plans import materialize, plain_views, registry
from tidemark.plans.registry import ALL, DEPENDS


def multiset(df):
    cols = sorted(df.columns)
    return Counter(tuple(norm(r[c], True) for c in cols) for r in df.select(*cols).collect())


def test_order_puts_parents_first():
    seq = materialize.order(list(ALL))
    assert sorted(seq) == sorted(ALL)
    for child, parents in DEPENDS.items():
        assert all(seq.index(p) < seq.index(child) for p in parents)


@pytest.fixture(scope="module")
def built(spark, scratch):
    src = write_star(spark, os.path.join(scratch, "mat-src"))
    out = os.path.join(scratch, "mat-out")
    paths = materialize.build_all(src, Params(), out)
    return src, out, paths


def test_star_round_trip(spark, built):
    from tidemark.sources.star import read_star
    src, out, _ = built
    star = os.path.join(materialize.current(spark, out), "star")
    stored = read_star(spark, star)
    for attr in ("accounts", "subscriptions", "events"):
        a, b = getattr(src, attr), getattr(stored, attr).select(*getattr(src, attr).columns)
        assert multiset(a) == multiset(b), attr
    assert os.path.isdir(os.path.join(star, "fact_events", "event_month=2025-08-01"))


@pytest.mark.parametrize("name", sorted(ALL))
def test_stored_view_equals_direct(spark, built, name):
    src, out, paths = built
    if name in plain_views.PLAIN:
        assert name not in paths
        stored = registry.publish(plain_views.read(spark, materialize.current(spark, out) + "/star", name))
        direct = registry.run(name, src, Params(as_of=date.today()))
    else:
        stored = registry.publish(spark.read.parquet(paths[name]))
        direct = registry.run(name, src)
    assert multiset(stored) == multiset(direct)


def test_resume_skips_finished(spark, built):
    src, out, paths = built
    mtime = os.path.getmtime(os.path.join(paths["mrr_arr_snapshot"], "_SUCCESS"))
    materialize.build_all(src, Params(), out, names=["mrr_arr_snapshot"], resume=True)
    assert os.path.getmtime(os.path.join(paths["mrr_arr_snapshot"], "_SUCCESS")) == mtime


def test_other_params_or_input_start_a_new_run(spark, scratch):
    from tidemark.sources.star import read_star

    src = os.path.join(scratch, "changing")
    write_star(spark, src)
    out = "file://" + os.path.join(scratch, "changing-out")
    build = lambda p: materialize.build_all(read_star(spark, src), p, out, names=["renewals_due"], resume=True)
    first, other = build(Params()), build(Params(as_of=date(2025, 10, 1)))
    assert first != other and materialize.current(spark, out) in other["renewals_due"]
    direct = registry.run("renewals_due", read_star(spark, src), Params(as_of=date(2025, 10, 1)))
    assert multiset(registry.publish(spark.read.parquet(other["renewals_due"]))) == multiset(direct)
    assert spark.read.parquet(first["renewals_due"]).count() > 0     # the old snapshot stays
    assert build(Params()) == first
    read_star(spark, src).contacts.limit(1).write.mode("append").parquet(f"{src}/dim_contacts")
    assert build(Params()) != first


def test_live_view_after_an_append(spark, scratch):
    from pyspark.sql import functions as F
    from tidemark.plans import catalog
    from tidemark.sources.star import read_star

    src = os.path.join(scratch, "growing")
    write_star(spark, src)
    load = lambda: read_star(spark, src)
    before = multiset(catalog.live(load, "monthwise_cancelled"))
    later = load().subscriptions.where("subscription_id IS NOT NULL").withColumn(
        "subscription_id", F.col("subscription_id") + 9000).withColumn("start_date", F.add_months("start_date", 12))
    later = spark.createDataFrame(later.collect(), later.schema)
    later.write.mode("append").parquet(f"{src}/fact_subscriptions")
    after = multiset(catalog.live(load, "monthwise_cancelled"))
    assert after == multiset(registry.run("monthwise_cancelled", load())) != before


def test_views_by_name(spark, built):
    from tidemark.plans import catalog
    src, out, _ = built
    names = catalog.register_views(src, Params(), names=["mrr_arr_snapshot", "kpi_mrr"], prefix="live_")
    assert names == ["live_mrr_arr_snapshot", "live_kpi_mrr"]
    live = spark.sql("SELECT sum(net_mrr_usd) AS s FROM live_mrr_arr_snapshot").collect()[0].s
    assert live == pytest.approx(spark.sql("SELECT mrr FROM live_kpi_mrr").collect()[0].mrr)
    stored = catalog.register_stored(spark, f"file://{materialize.current(spark, out)}/views", prefix="mv_")
    assert len(stored) == len(ALL)
    assert spark.sql("SELECT count(*) AS n FROM mv_dim_device").collect()[0].n == 3
