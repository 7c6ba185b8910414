"""Physical-plan properties that matter at scale."""

from __future__ import annotations

import contextlib
import io
import os
import re

import pytest

from edge_star import write_star
from tidemark.plans import registry
from tidemark.sources.star import load_star

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture(scope="module")
def t(spark):
    return load_star(spark, SF)


@pytest.mark.parametrize("name", sorted(registry.ALL))
def test_no_cartesian_or_nested_loop(t, name):
    text = plan(registry.run(name, t))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def _tree(text: str):
    """(depth, node) pairs of the optimized logical plan."""
    body = text.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    out = []
    for line in body.strip("\n").splitlines():
        m = re.search(r"[:+]- ", line)
        depth = (m.start() // 3 + 1) if m else 0
        node = line[m.end():] if m else line.strip()
        out.append((depth, node.split(" ")[0]))
    return out


def _children(tree, i):
    d = tree[i][0]
    kids = []
    for j in range(i + 1, len(tree)):
        if tree[j][0] <= d:
            break
        if tree[j][0] == d + 1:
            kids.append(j)
    return kids


def _reaches_aggregate_first(tree, i):
    for j in range(i, len(tree)):
        if j > i and tree[j][0] <= tree[i][0]:
            break
        name = tree[j][1]
        if name == "Aggregate":
            return True
        if name in ("Join", "Relation", "LogicalRDD", "Range"):
            return False
    return False


def _subtree_lines(lines, tree, i):
    d = tree[i][0]
    out = [lines[i]]
    for j in range(i + 1, len(tree)):
        if tree[j][0] <= d:
            break
        out.append(lines[j])
    return out


@pytest.mark.parametrize("name", ["overall_utilization", "specific_utilization", "kpi_seat_utilization",
                                  "current_mrr_for_nrr", "nrr_account_level", "kpi_nrr",
                                  "kpi_mrr", "kpi_arr", "kpi_mrr_yoy", "kpi_mrr_mom",
                                  "kpi_mrr_growth_vs_prior_december", "kpi_revenue_share_by_product",
                                  "kpi_active_base_share_by_segment", "kpi_revenue_by_segment",
                                  "kpi_auto_renew_share", "kpi_mrr_trend", "seat_utilization_exact"])
def test_fanout_views_join_no_raw_subscriptions(t, name):
    """The fan-out views (seat sums, NRR pairs) and the totals never join
    subscription rows: every join input that reads them is aggregated first."""
    text = plan(registry.run(name, t), "extended")
    body = text.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    lines = body.strip("\n").splitlines()
    tree = _tree(text)
    joins = [i for i, (_, n) in enumerate(tree) if n == "Join"]
    assert joins
    for i in joins:
        for k in _children(tree, i):
            if any("o_orderkey" in line for line in _subtree_lines(lines, tree, k)):
                assert _reaches_aggregate_first(tree, k), body


def test_scans_are_pruned(t):
    text = plan(registry.run("dim_device", t))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert schemas == ["struct<event_id:bigint>"]


def test_anchor_filters_reach_stored_star(spark, scratch):
    star = write_star(spark, os.path.join(scratch, "plans"))
    text = plan(registry.run("mrr_arr_snapshot", star))
    pushed = " ".join(re.findall(r"PushedFilters: (.*)", text))
    assert "EqualTo(status,Active)" in pushed
    assert "LessThanOrEqual(start_date,2025-07-31)" in pushed
    text = plan(registry.run("stickiness", star))
    pushed = " ".join(re.findall(r"PushedFilters: (.*)", text))
    assert "GreaterThanOrEqual(event_timestamp,2025-08-01T00:00)" in pushed


def _scan_locations(text: str) -> dict[str, str]:
    """node id -> scanned location, from the per-node detail blocks."""
    out = {}
    for block in re.split(r"\n(?=\(\d+\) )", text):
        m = re.match(r"\((\d+)\) Scan parquet", block)
        loc = re.search(r"Location: \S+ \[([^\]]*)\]", block)
        if m and loc:
            out[m.group(1)] = loc.group(1)
    return out


@pytest.mark.parametrize("name", sorted(registry.ALL))
def test_each_fact_scanned_once(t, name):
    df = registry.run(name, t)
    df.collect()  # with AQE, exchange reuse shows in the final plan only
    text = plan(df)
    final_tree = text.split("== Initial Plan ==")[0]
    in_final = set(re.findall(r"Scan parquet\s+\((\d+)\)", final_tree))
    locs = [loc for n, loc in _scan_locations(text).items() if n in in_final]
    for fact in ("orders", "events"):
        assert sum(f"{fact}.parquet" in loc for loc in locs) <= 1, (fact, final_tree)


@pytest.mark.parametrize("name", ["adoption_devices", "kpi_device_adoption", "churn_status", "active_users",
                                  "churned_users", "kpi_auto_renew_share"])
def test_raw_rows_meet_a_hash_aggregate_first(t, name):
    """No Expand and no sort fallback over raw rows: above a fact's scan the
    first aggregate is a HashAggregate."""
    tree = plan(registry.run(name, t), "simple")
    above = []
    for line in tree.splitlines():
        node = re.sub(r"^[\s:+\-]*(\*\(\d+\) )?", "", line)
        depth = len(line) - len(node)
        above = [(d, n) for d, n in above if d < depth] + [(depth, node)]
        if node.startswith("FileScan") and ("o_orderkey" in node or "event_id" in node):
            near = [n.split("(")[0].split(" ")[0] for _, n in reversed(above)]
            first = next(n for n in near if "Aggregate" in n or n == "Expand")
            assert first == "HashAggregate", tree


@pytest.mark.parametrize("name", ["renewals_due", "renewal_pipeline"])
def test_renewals_read_part_once_without_sort_aggregate(t, name):
    text = plan(registry.run(name, t))
    assert "SortAggregate" not in text
    assert sum("part.parquet" in loc for loc in _scan_locations(text).values()) == 1


@pytest.mark.parametrize("name", ["current_mrr_for_nrr", "kpi_nrr", "nrr_account_level"])
def test_nrr_prunes_the_stored_star(t, spark, scratch, name):
    from tidemark.plans import materialize

    star = materialize.write_star(t, os.path.join(scratch, f"pruned-{name}"))
    text = plan(registry.run(name, star))
    found = " ".join(re.findall(r"PartitionFilters: (.*)", text))
    assert "status_part" in found and "Active" in found
