"""Totals over time by a sweep, and the KPIs from the slicer cube."""

from __future__ import annotations

import os
from collections import Counter
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from edge_star import SUBS, write_star
from oracle.compare import norm
from tidemark.functions.predicates import SLICE
from tidemark.operators import timeline
from tidemark.params import Params
from tidemark.plans import cube, registry
from tidemark.sources.star import read_star


def multiset(df):
    cols = sorted(df.columns)
    return Counter(tuple(norm(r[c], True) for c in cols) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def t(spark, scratch):
    # Beside the edge cases: ended before it started, one day long, no price, no start.
    row = lambda i, start, end, mrr: (i, 1, 1, 1, start, end, "Active", date(2025, 9, 1), mrr, 1, 1, True)
    more = [row(301, date(2025, 3, 10), date(2025, 3, 1), Decimal("7.00")), row(302, date(2025, 6, 30), date(2025, 6, 30), Decimal("3.00")),
            row(303, date(2025, 1, 1), None, None), row(304, None, None, Decimal("9.00")),
            row(305, date(2024, 7, 1), date(2024, 7, 31), Decimal("1.50")), row(306, date(2024, 7, 2), date(2024, 7, 31), Decimal("2.50")),
            row(307, date(2024, 6, 1), date(2024, 7, 30), Decimal("4.50"))]
    out = os.path.join(scratch, "timeline")
    write_star(spark, out, {"subscriptions": SUBS + more})
    return read_star(spark, out)


def test_every_day_of_the_timeline(t):
    """The running sums give each day's snapshot, for days between changes too."""
    rows = [r.asDict() for r in timeline.mrr_timeline(t, Params()).collect()]
    assert len(rows) > 10
    day = date(2024, 1, 1)
    while day < date(2025, 12, 31):
        got = Counter()
        for key in {tuple(r[c] for c in SLICE) for r in rows}:
            last = max((r for r in rows if tuple(r[c] for c in SLICE) == key and r["day"] <= day), key=lambda r: r["day"], default=None)
            if last and last["subscriptions"]:
                got[key, last["subscriptions"], last["mrr"]] += 1
        expected = Counter()
        held: dict = {}
        for r in _live(t, day):
            held.setdefault(r[:4], []).append(r[4])
        for key, values in held.items():
            expected[key, len(values), sum((v or Decimal(0) for v in values), Decimal(0)).quantize(Decimal("0.01"))] += 1
        assert got == expected, day
        day += timedelta(days=17)


_rows: list = []


def _live(t, day):
    if not _rows:
        _rows.extend(t.subscriptions.where("status = 'Active' AND start_date IS NOT NULL").join(t.accounts, "account_sk").select(
            *SLICE, "net_mrr_usd", "start_date", "end_date").collect())
    return [tuple(r)[:5] for r in _rows if r["start_date"] <= day and (r["end_date"] is None or r["end_date"] >= day)]


def test_totals_equal_the_views(t):
    p = Params()
    for r in timeline.mrr_at_anchors(t, p).collect():
        total = registry.VIEWS[r["snapshot"]](t, p).agg(F.sum("net_mrr_usd"), F.count(F.lit(1))).first()
        assert (r["mrr"], r["subscriptions"]) == (total[0], total[1]), r


def test_no_subscriptions(spark, scratch):
    out = os.path.join(scratch, "timeline-empty")
    write_star(spark, out, {"subscriptions": []})
    empty = read_star(spark, out)
    assert timeline.mrr_timeline(empty, Params()).collect() == []
    assert all(r["mrr"] is None and r["subscriptions"] == 0 for r in timeline.mrr_at_anchors(empty, Params()).collect())


@pytest.fixture(scope="module")
def stored_cube(spark, scratch, t):
    path = os.path.join(scratch, "cube")
    cube.slicer_cube(t, Params()).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("slicers", [
    {}, {"product_sk": 1}, {"segment": "SMB", "industry": "IND_1"},
    {"product_sk": 2, "industry": "IND_2", "segment": "SMB", "hq_country": "DE"}, {"hq_country": "nowhere"}])
def test_kpis_from_the_cube(t, stored_cube, slicers):
    p = Params(slicers=slicers)
    for name in cube.KPIS:
        got, direct = registry.publish(cube.kpi(name, stored_cube, p)), registry.run(name, t, p)
        assert got.schema.simpleString() == direct.schema.simpleString(), name
        assert multiset(got) == multiset(direct), name


def test_null_attributes_are_not_all(stored_cube):
    """Account 6 has no segment: its rows stand beside those of all segments."""
    rows = stored_cube.where((F.col("level") == cube.level_of(["segment"])) & F.col("segment").isNull()).collect()
    assert len(rows) == 1
    assert rows[0]["mrr"] != stored_cube.where("level = 0").first()["mrr"]


def test_unknown_slicer(stored_cube):
    with pytest.raises(ValueError):
        cube.kpi("kpi_mrr", stored_cube, Params(slicers={"colour": "red"}))
