"""Query keys -> operators, and the published form of each result.

Operators return their natural types (money as exact decimals, calendar days
as dates). ``publish`` casts decimal columns to float8 at the very end, after
all arithmetic is done exactly, so the published number is the correctly
rounded double of the exact value on any engine, and dates to timestamps at
midnight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import cohorts, corrected, customers, kpis, revenue, timeline, usage
from tidemark.params import Params
from tidemark.sources.star import Tables

Operator = Callable[[Tables, Params], DataFrame]

# Exploratory queries (E1-E5) and views (V1-V35), keyed by their view names.
VIEWS: dict[str, Operator] = {
    "new_customers_by_segment": customers.new_customers_by_segment,      # E1
    "churn_summary_ytd": customers.churn_summary_ytd,                    # E2
    "renewals_due": customers.renewals_due,                              # E3
    "cohort_survival": cohorts.cohort_survival,                          # E4
    "feature_adoption_pct": usage.feature_adoption_pct,                  # E5
    "mrr_arr_snapshot": revenue.mrr_arr_snapshot,                        # V1
    "dim_segment_view": customers.dim_segment_view,                      # V2
    "dim_industry_view": customers.dim_industry_view,                    # V3
    "fact_mrr_accounts": revenue.fact_mrr_accounts,                      # V4
    "fact_previous_month_net_mrr": revenue.fact_previous_month_net_mrr,  # V5
    "previous_year_mrr": revenue.previous_year_mrr,                      # V6
    "previous_mrr_for_nrr": revenue.previous_mrr_for_nrr,                # V7
    "current_mrr_for_nrr": revenue.current_mrr_for_nrr,                  # V8
    "churn_rate": customers.churn_rate,                                  # V9
    "stickiness": usage.stickiness,                                      # V10
    "churn_status": customers.churn_status,                              # V11
    "active_users": customers.active_users,                              # V12
    "churned_users": customers.churned_users,                            # V13
    "overall_utilization": customers.overall_utilization,                # V14
    "specific_utilization": customers.specific_utilization,              # V15
    "renewal_pipeline": customers.renewal_pipeline,                      # V16
    "renew_disabled": customers.renew_disabled,                          # V17
    "renew_enabled": customers.renew_enabled,                            # V18
    "monthwise_cancelled": cohorts.monthwise_cancelled,                  # V19
    "sub_trend": cohorts.sub_trend,                                      # V20
    "retention_cohort": cohorts.retention_cohort,                        # V21
    "dim_device": usage.dim_device,                                      # V22
    "feature_usage_active_users": usage.feature_usage_active_users,      # V23
    "feature_usage_adopted_users": usage.feature_usage_adopted_users,    # V24
    "event_depth": usage.event_depth,                                    # V25
    "adoption_rates": usage.adoption_rates,                              # V26
    "adoption_devices": usage.adoption_devices,                          # V27
    "login_frequency": usage.login_frequency,                            # V28
    "product_users_by_country": usage.product_users_by_country,          # V29
    "specific_page_usage": usage.specific_page_usage,                    # V30
    "previous_window_mrr_snapshot": revenue.previous_window_mrr_snapshot,  # V31
    "acv": revenue.acv,                                                  # V32
    "arpa": revenue.arpa,                                                # V33
    "churn_revenue": revenue.churn_revenue,                              # V34
    "adoption_products": usage.adoption_products,                        # V35
}

KPIS: dict[str, Operator] = {
    "kpi_mrr": kpis.kpi_mrr,                                             # K1
    "kpi_arr": kpis.kpi_arr,                                             # K2
    "kpi_mrr_yoy": kpis.kpi_mrr_yoy,                                     # K3
    "kpi_mrr_mom": kpis.kpi_mrr_mom,                                     # K4
    "kpi_mrr_growth_vs_prior_december": kpis.kpi_mrr_growth_vs_prior_december,  # K5
    "kpi_nrr": kpis.kpi_nrr,                                             # K6
    "kpi_revenue_share_by_product": kpis.kpi_revenue_share_by_product,   # K7
    "kpi_churned_revenue_by_industry": kpis.kpi_churned_revenue_by_industry,  # K8
    "kpi_active_base_share_by_segment": kpis.kpi_active_base_share_by_segment,  # K9
    "kpi_revenue_by_segment": kpis.kpi_revenue_by_segment,               # K10
    "kpi_seat_utilization": kpis.kpi_seat_utilization,                   # K11
    "kpi_auto_renew_share": kpis.kpi_auto_renew_share,                   # K12
    "kpi_feature_adoption": kpis.kpi_feature_adoption,                   # K13
    "kpi_device_adoption": kpis.kpi_device_adoption,                     # K14
    "kpi_mrr_trend": kpis.kpi_mrr_trend,                                 # K15
}

# Corrected variants of results that run but mislead (kept apart from the
# faithful views).
CORRECTED: dict[str, Operator] = {
    "seat_utilization_exact": corrected.seat_utilization_exact,          # Q1
    "nrr_account_level": corrected.nrr_account_level,                    # Q2
    "cohort_survival_calendar": corrected.cohort_survival_calendar,      # Q3
}

# Totals over time from one pass (operators.timeline).
TIMELINE: dict[str, Operator] = {
    "mrr_timeline": timeline.mrr_timeline,
    "mrr_at_anchors": timeline.mrr_at_anchors,                           # totals of V1, V5, V6, V7, V31
}

ALL: dict[str, Operator] = {**VIEWS, **KPIS, **CORRECTED, **TIMELINE}

# Views read by other views (child -> parents); materialization writes
# parents first and children read the stored parent. Plain views
# (plans.plain_views) are nobody's stored parent.
DEPENDS: dict[str, tuple[str, ...]] = {
    "churn_rate": ("churn_summary_ytd",),
    "sub_trend": ("cohort_survival",),
    "retention_cohort": ("sub_trend",),
    "kpi_mrr": ("mrr_arr_snapshot",),
    "kpi_arr": ("mrr_arr_snapshot",),
    "kpi_mrr_yoy": ("mrr_arr_snapshot", "previous_window_mrr_snapshot"),
    "kpi_mrr_mom": ("mrr_arr_snapshot", "fact_previous_month_net_mrr"),
    "kpi_mrr_growth_vs_prior_december": ("mrr_arr_snapshot", "previous_year_mrr"),
    "kpi_nrr": ("current_mrr_for_nrr", "previous_mrr_for_nrr"),
    "kpi_revenue_share_by_product": ("mrr_arr_snapshot",),
    "kpi_churned_revenue_by_industry": ("churn_revenue",),
    "kpi_active_base_share_by_segment": ("fact_mrr_accounts",),
    "kpi_revenue_by_segment": ("mrr_arr_snapshot",),
    "kpi_seat_utilization": ("specific_utilization",),
    "kpi_auto_renew_share": ("renew_enabled", "renew_disabled"),
    "kpi_feature_adoption": ("feature_usage_adopted_users", "feature_usage_active_users"),
    "kpi_mrr_trend": ("fact_mrr_accounts",),
}


# Published type of each natural type that differs between engines' clients.
_PUBLISHED = {T.DecimalType: "double", T.DateType: "timestamp_ntz"}


def publish(df: DataFrame) -> DataFrame:
    """The published form: exact decimals as float8, dates as midnight
    timestamps (the types every client reads alike); everything else as is.
    Stored views keep the natural types."""
    cols = []
    for f in df.schema.fields:
        target = next((t for cls, t in _PUBLISHED.items() if isinstance(f.dataType, cls)), None)
        cols.append(F.col(f.name).cast(target).alias(f.name) if target else F.col(f.name))
    return df.select(*cols)


def run(name: str, t: Tables, p: Params | None = None) -> DataFrame:
    return publish(ALL[name](t, p or Params()))
