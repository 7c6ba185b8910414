"""MRR over time by a sweep: one pass over the subscriptions instead of one
snapshot query a day.

Every Active subscription enters on its start day and leaves on the day after
its end. The entries and exits are summed per slice and day; running sums over
a slice's days then give what is live on any of them, and a total on a day is
the sum of all changes up to it. A window that must be covered whole (V31: live
from the first to the last day of a month) is what is live on its last day less
what started in the month after its first day and is still live at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import anchors as A
from tidemark.functions.fixed import ACTIVE
from tidemark.functions.joins import account_attrs
from tidemark.functions.predicates import ATTRS, SLICE
from tidemark.operators import revenue
from tidemark.params import Params
from tidemark.sources.star import Tables


def _changes(t: Tables) -> DataFrame:
    """Entries and exits per account, product and day, with the account's slice:
    ``mrr`` and ``n`` change on ``day``; ``late_mrr`` and ``late_n`` (on a month's last
    day) are of those that started in the month after its first day and are live at its end."""
    start, end = F.col("start_date"), F.col("end_date")
    live = t.subscriptions.where((F.col("status") == ACTIVE) & start.isNotNull() & (end.isNull() | (end >= start)))
    last = F.last_day(start)
    late = (start > F.trunc(start, "month")) & (end.isNull() | (end >= last))
    mrr, none = F.col("net_mrr_usd"), F.lit(None)
    row = lambda day, m, n, late_m, late_n: F.struct(
        day.alias("day"), m.cast("decimal(13,2)").alias("mrr"), F.lit(n).cast("bigint").alias("n"),
        late_m.cast("decimal(13,2)").alias("late_mrr"), F.lit(late_n).cast("bigint").alias("late_n"))
    moves = F.array(row(start, mrr, 1, none, 0), row(F.date_add(end, 1), -mrr, -1, none, 0),
                    row(F.when(late, last), none, 0, mrr, 1))
    # A hot account is a row per product and day before the account join.
    per_day = (live.select("account_sk", "product_sk", F.explode(moves).alias("c")).where("c.day IS NOT NULL")
               .groupBy("account_sk", "product_sk", "c.day")
               .agg(F.sum("c.mrr").alias("mrr"), F.sum("c.n").alias("n"), F.sum("c.late_mrr").alias("late_mrr"),
                    F.sum("c.late_n").alias("late_n"), F.max(F.col("c.n") != 0).alias("moves")))
    return per_day.join(account_attrs(t, *ATTRS), "account_sk").drop("account_sk")


def mrr_timeline(t: Tables, p: Params) -> DataFrame:
    """Per slice and day of a change: the MRR and the number of the Active
    subscriptions that are live from that day to the next change (V1's rule)."""
    per_day = _changes(t).where("moves").groupBy(*SLICE, "day").agg(
        F.sum(F.coalesce("mrr", F.lit(0))).alias("mrr"), F.sum("n").alias("n"))
    # A slice's days are bounded by the calendar.
    so_far = Window.partitionBy(*SLICE).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select(*SLICE, "day", F.sum("mrr").over(so_far).alias("mrr"),
                          F.sum("n").over(so_far).cast("bigint").alias("subscriptions"))


def anchor_windows(t: Tables, p: Params) -> dict[str, tuple]:
    """The report's snapshot windows: (started by, not ended before)."""
    d, month = A.latest_start(t), revenue.previous_month_day(t)
    december, base = revenue.prior_december_day(t), revenue.nrr_base_day(t, p)
    return {"mrr_arr_snapshot": (d, d), "fact_previous_month_net_mrr": (month, month),
            "previous_year_mrr": (december, december), "previous_mrr_for_nrr": (base, base),
            "previous_window_mrr_snapshot": revenue.year_ago_month(t)}


def mrr_at_anchors(t: Tables, p: Params) -> DataFrame:
    """Totals (and rows) of the five snapshot views (V1, V5, V6, V7, V31) from one
    pass: a conditional sum of the changes for each; NULL for a view without rows."""
    windows = anchor_windows(t, p)
    day, zero = F.col("day"), F.lit(0)
    sums, rows = [], []
    for i, (name, (first, last)) in enumerate(windows.items()):
        up_to = day <= A.date_lit(last)
        late = (day == A.date_lit(last)) if first != last else F.lit(False)
        sums += [F.sum(F.when(up_to, F.coalesce("mrr", zero))).alias(f"live{i}"), F.sum(F.when(up_to, F.col("n"))).alias(f"n{i}"),
                 F.sum(F.when(late, F.coalesce("late_mrr", zero))).alias(f"late{i}"), F.sum(F.when(late, F.col("late_n"))).alias(f"late_n{i}")]
        n = F.coalesce(f"n{i}", zero) - F.coalesce(f"late_n{i}", zero)
        total = (F.col(f"live{i}") - F.coalesce(f"late{i}", zero)).cast("decimal(38,2)")
        rows.append(F.struct(F.lit(name).alias("snapshot"), A.date_lit(first).alias("first_day"), A.date_lit(last).alias("last_day"),
                             F.when(n > 0, total).alias("mrr"), n.cast("bigint").alias("subscriptions")))
    return _changes(t).agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
