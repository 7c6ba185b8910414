"""Hand-built star tables (tests/edge_star.py): every view against the same
oracle SQL run by DuckDB on the same stored tables, plus the expected values
of each edge case."""

from __future__ import annotations

import os
from datetime import date, datetime

import pytest

from edge_star import STAR_NAMES, write_star
import oracle
from oracle.compare import compare, duck_for_star
from tidemark.params import Params
from tidemark.plans import registry


@pytest.fixture(scope="module")
def star(spark, scratch):
    out = os.path.join(scratch, "edge")
    return out, write_star(spark, out)


@pytest.fixture(scope="module")
def con(star):
    return duck_for_star(star[0], STAR_NAMES)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ALL))
def test_edge_parity(star, con, name):
    ok, msg = compare(registry.run(name, star[1]), con, oracle.QUERIES[name], strict=True)
    assert ok, msg


def test_churn_summary(star):
    # base on Jan 1: accounts 1,2,6 keep an Active sub; 3 all Cancelled,
    # 5 only 'Inactive' (LIKE is case-sensitive), 7 only NULL statuses.
    r = registry.run("churn_summary_ytd", star[1]).collect()
    assert [tuple(x) for x in r] == [(6, 3, 50.0)]


def test_churn_status_sets(star):
    got = dict(rows(registry.run("churn_status", star[1]), "account_sk", "agg_status"))
    assert None not in got                       # NULL account dropped
    assert got[1] == "Active,Cancelled"
    assert got[5] == "Inactive"
    assert got[6] == "Active"                    # NULL status skipped
    assert got[7] is None                        # all NULL
    counts = dict(rows(registry.run("churn_status", star[1]), "account_sk", "status_counts"))
    assert counts[5].startswith("Inactive:") and counts[7] is None


def test_active_and_churned_users(star):
    t = star[1]
    assert rows(registry.run("active_users", t), "account_sk") == [(1,), (6,)]
    assert rows(registry.run("churned_users", t), "account_sk") == [(3,), (7,)]   # 4: no subs


def test_renewal_window_and_orphans(star):
    # 101 at as_of (in), 102 at +90 (in), 113 at +121 (out), 110 NULL account,
    # 117 orphan plan: dropped.
    got = rows(registry.run("renewals_due", star[1]), "subscription_id")
    assert got == [(101,), (102,), (111,), (114,)]


def natural(name, t):
    """The operator's own output (dates as dates), before publishing."""
    return registry.ALL[name](t, Params())


def test_cohort_survival(star):
    got = rows(natural("cohort_survival", star[1]), "date", "effective_sub_count")
    assert got == [(date(2024, 12, 31), 14), (date(2025, 1, 1), 13), (date(2025, 2, 1), 12),
                   (date(2025, 10, 1), 11), (date(2025, 11, 1), 10), (date(2025, 12, 1), 9)]
    r = registry.run("retention_cohort", star[1]).collect()[0]
    assert (r.inital_sub_count, r.final_sub_count) == (14, 9)
    # published form: the same days as midnight timestamps
    pub = rows(registry.run("cohort_survival", star[1]), "date")
    assert [d[0] for d in pub] == [datetime.combine(g[0], datetime.min.time()) for g in got]
    cal = rows(natural("cohort_survival_calendar", star[1]), "date", "effective_sub_count")
    assert cal == [(date(2024, 12, 31), 14), (date(2025, 2, 1), 13)]


def test_stickiness(star):
    got = dict(rows(registry.run("stickiness", star[1]), "product_sk", "stickiness"))
    assert got == {1: pytest.approx(2 / 3), 2: 0.0, None: 0.0}


def test_event_depth_bounds(star):
    # 2024-12-31 00:00:00 is in, 00:00:01 is out.
    got = rows(registry.run("event_depth", star[1]), "product_sk", "segment", "events_count")
    assert got == [(1, "Enterprise", 1.0), (1, "SMB", 1.0)]


def test_page_usage_missing_key(star):
    got = rows(registry.run("specific_page_usage", star[1]), "product_sk", "specific_page",
               "specific_page_views", "total_page_views")
    assert got == [(2, "pricing", 2, 3), (2, None, 1, 3)]


def test_login_frequency(star):
    assert rows(registry.run("login_frequency", star[1]), "product_sk", "segment",
                "login_frequency") == [(1, "Enterprise", 1.5)]


def test_auto_renew_null_in_neither(star):
    t = star[1]
    on = sum(r.renew_enabled_count for r in registry.run("renew_enabled", t).collect())
    off = sum(r.renew_disabled_count for r in registry.run("renew_disabled", t).collect())
    assert (on, off) == (5, 1)   # Active subs with an account: 101,111,113,114,117 / 102


def test_partial_month_absent_from_year_ago_window(star):
    # 113 starts 2024-07-15: live at D, not for the whole of July 2024.
    t = star[1]
    ids_now = {r.net_mrr_usd for r in registry.run("mrr_arr_snapshot", t).collect()}
    ids_then = {r.net_mrr_usd for r in registry.run("previous_window_mrr_snapshot", t).collect()}
    assert 0.01 in ids_now and 0.01 not in ids_then


def test_empty_subscriptions(spark, scratch):
    t = write_star(spark, os.path.join(scratch, "empty"), {"subscriptions": []})
    assert [tuple(r) for r in registry.run("churn_summary_ytd", t).collect()] == [(0, None, None)]
    assert [tuple(r) for r in registry.run("churn_rate", t).collect()] == [(None,)]
    assert registry.run("cohort_survival", t).count() == 0
    assert registry.run("retention_cohort", t).count() == 0


def test_january_anchors(spark, scratch, star):
    from edge_star import ACCOUNTS, SUBS
    accounts = [a[:4] + (date(2025, 1, 20) if a[0] == 1 else min(a[4], date(2024, 12, 1)),)
                for a in ACCOUNTS]
    subs = [s[:4] + (min(s[4], date(2025, 1, 15)),) + s[5:] for s in SUBS]
    t = write_star(spark, os.path.join(scratch, "january"), {"accounts": accounts, "subscriptions": subs})
    con = duck_for_star(os.path.join(scratch, "january"), STAR_NAMES)
    for name in ["new_customers_by_segment", "fact_previous_month_net_mrr", "previous_mrr_for_nrr",
                 "churn_summary_ytd", "kpi_mrr_mom"]:
        ok, msg = compare(registry.run(name, t), con, oracle.QUERIES[name], strict=True)
        assert ok, (name, msg)
    # Latest creation in January -> the whole previous year.
    got = rows(registry.run("new_customers_by_segment", t), "segment", "customer_count")
    assert sum(n for _, n in got) == 5          # 2,3,4,6,7 created in 2024; 5 in 2023


def test_slicers(star):
    p = Params(slicers={"segment": "Enterprise"})
    full = registry.run("kpi_mrr", star[1]).collect()[0].mrr
    ent = registry.run("kpi_mrr", star[1], p).collect()[0].mrr
    assert 0 < ent < full


def test_nrr_pairs_are_counted_not_emitted(star):
    # account 1: two base-period rows (101, 114 live at 2024-08-31) and three
    # current subscriptions (101, 102, 114): 6 pairs, published as 2 rows.
    rows_1 = [r for r in registry.run("current_mrr_for_nrr", star[1]).collect() if r.account_sk == 1]
    assert len(rows_1) == 2
    assert sum(r.pair_count for r in rows_1) == 6
    assert sum(r.net_mrr_usd for r in rows_1) == pytest.approx(2 * (100.00 + 50.10 + 70.00))


def test_seat_fanout(star):
    # account 1 has 3 open Active subs (101, 102, 114); its seats over all 4
    # subs are counted 3 times by the original's join.
    got = {r.product_sk: r.specific_seat_commits
           for r in registry.run("specific_utilization", star[1]).collect() if r.segment == "Enterprise"}
    assert got == {1: 26.0, 2: 26.0, 3: 26.0}
    exact = registry.run("seat_utilization_exact", star[1]).collect()[0]
    fan = registry.run("overall_utilization", star[1]).collect()[0]
    assert exact.total_seat_commits < fan.total_seat_commits
