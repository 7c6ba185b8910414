"""The additive KPIs under any slicers, from one small table.

``slicer_cube`` sums what the KPIs add up, by every subset of the dashboard's
slicers (product, industry, segment, country): the views it reads are per slice
already, so the sixteen grouping sets run over a table of slices, not of
subscriptions. ``level`` tells which slicers a row is grouped by (a bit each, in
the order of SLICE), so a NULL attribute is not taken for "all".

``kpi`` answers a KPI for ``Params.slicers`` from the cube's rows of one level.
Counts of distinct accounts, contacts and subscriptions over slices don't add
and are not in it; K12's counts are per slice, as its views have them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fixed import MONTHS_PER_YEAR
from tidemark.functions.predicates import SLICE, ratio
from tidemark.functions.views import parent
from tidemark.operators import customers, revenue
from tidemark.operators.kpis import _growth, _share
from tidemark.params import Params
from tidemark.sources.star import Tables

# Measure -> (view, column of it).
MEASURES = {
    "mrr": (revenue.mrr_arr_snapshot, "net_mrr_usd"),
    "year_ago_mrr": (revenue.previous_window_mrr_snapshot, "net_mrr_usd"),
    "month_ago_mrr": (revenue.fact_previous_month_net_mrr, "net_mrr_usd"),
    "december_mrr": (revenue.previous_year_mrr, "net_mrr_usd"),
    "nrr_current": (revenue.current_mrr_for_nrr, "net_mrr_usd"),
    "nrr_prior": (revenue.previous_mrr_for_nrr, "net_mrr_usd"),
    "churn_revenue": (revenue.churn_revenue, "churn_revenue"),
    "seat_commits": (customers.specific_utilization, "specific_seat_commits"),
    "seat_provisions": (customers.specific_utilization, "specific_seat_provisions"),
    "renew_on": (customers.renew_enabled, "renew_enabled_count"),
    "renew_off": (customers.renew_disabled, "renew_disabled_count"),
}


def slicer_cube(t: Tables, p: Params) -> DataFrame:
    """Sums of MEASURES by every subset of the slicers; NULL where no row has one."""
    views: dict = {}
    for name, (view, column) in MEASURES.items():
        views.setdefault(view, {})[name] = column
    parts = []
    for view, own in views.items():
        per_slice = parent(t, p, view).groupBy(*SLICE).agg(*[F.sum(c).cast("decimal(38,2)").alias(n) for n, c in own.items()])
        parts.append(per_slice.select(*SLICE, *[F.col(n) if n in own else F.lit(None).cast("decimal(38,2)").alias(n)
                                                for n in MEASURES]))
    slices = reduce(DataFrame.unionByName, parts).groupBy(*SLICE).agg(*[F.sum(n).cast("decimal(38,2)").alias(n) for n in MEASURES])
    # grouping_id has a bit set for each column that is summed over.
    level = (F.lit((1 << len(SLICE)) - 1) - F.grouping_id()).cast("int")
    return slices.cube(*SLICE).agg(level.alias("level"), *[F.sum(n).cast("decimal(38,2)").alias(n) for n in MEASURES])


def level_of(columns) -> int:
    return sum(1 << (len(SLICE) - 1 - SLICE.index(c)) for c in set(columns))


def _rows(cube: DataFrame, p: Params, *by: str) -> DataFrame:
    """The cube's rows of the slicers' values, one for each value of ``by``."""
    unknown = set(p.slicers) - set(SLICE)
    if unknown:
        raise ValueError(f"no such slicer: {sorted(unknown)}")
    rows = cube.where(F.col("level") == level_of([*p.slicers, *by]))
    for c, value in p.slicers.items():
        rows = rows.where(F.col(c) == F.lit(value))
    return rows


def _one(cube: DataFrame, p: Params, *columns: Column) -> DataFrame:
    """One row, of NULLs where no slice has the slicers' values."""
    return _rows(cube, p).agg(*[F.max(n).alias(n) for n in MEASURES]).select(*columns)


def _growth_from(prior: str):
    return lambda cube, p: _one(cube, p, F.col("mrr"), F.col(prior).alias("prior_mrr"),
                                _growth(F.col("mrr"), F.col(prior)).alias("mrr_growth"))


def _held(rows: DataFrame, measure: str) -> DataFrame:
    """Groups that have the measure at all."""
    return rows.where(F.col(measure).isNotNull())


# KPI -> its result from the cube.
KPIS = {
    "kpi_mrr": lambda cube, p: _one(cube, p, F.col("mrr")),
    "kpi_arr": lambda cube, p: _one(cube, p, (F.col("mrr") * MONTHS_PER_YEAR).alias("arr")),
    "kpi_mrr_yoy": _growth_from("year_ago_mrr"),
    "kpi_mrr_mom": _growth_from("month_ago_mrr"),
    "kpi_mrr_growth_vs_prior_december": _growth_from("december_mrr"),
    "kpi_nrr": lambda cube, p: _one(cube, p, F.col("nrr_current").alias("current_mrr"), F.col("nrr_prior").alias("prior_mrr"),
                                    ratio(F.col("nrr_current"), F.col("nrr_prior")).alias("nrr")),
    "kpi_revenue_share_by_product": lambda cube, p: _share(
        _held(_rows(cube, p, "product_sk"), "mrr"), "product_sk", "mrr", "revenue_share"),
    "kpi_churned_revenue_by_industry": lambda cube, p: _held(_rows(cube, p, "industry"), "churn_revenue").select(
        "industry", "churn_revenue"),
    "kpi_revenue_by_segment": lambda cube, p: _held(_rows(cube, p, "segment"), "mrr").select("segment", "mrr"),
    "kpi_seat_utilization": lambda cube, p: _one(
        cube, p, F.col("seat_commits").alias("total_seat_commits"), F.col("seat_provisions").alias("total_seat_provisions"),
        ratio(F.col("seat_provisions"), F.col("seat_commits")).alias("seat_utilization")),
    "kpi_auto_renew_share": lambda cube, p: _one(
        cube, p, F.col("renew_on").cast("bigint").alias("auto_renew_count"),
        F.col("renew_off").cast("bigint").alias("manual_renew_count"),
        ratio(F.col("renew_on"), F.col("renew_on") + F.col("renew_off")).alias("auto_renew_share")),
}


def kpi(name: str, cube: DataFrame, p: Params) -> DataFrame:
    return KPIS[name](cube, p)
