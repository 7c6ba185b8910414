"""The report's three plain views as SQL views: nothing is stored and nothing is
fixed when they are made.

``create`` puts views into the session (temporary) or the catalog. Their text
reads the stored star's folders, so a query lists the files of that moment, and
the latest subscription start and the current date are scalar subqueries and
functions of the text, evaluated at every read. Each bound of a window is one
scalar subquery, which Spark evaluates first and then uses as a literal: it
reaches the parquet scan as a pushed filter, and the status stays a partition
filter.

The anchor is the MAX of one column of the fact (``anchors="scan"``), right
whoever adds files. With ``anchors="zones"`` it is read from the star's zone map
instead and opens no file of the fact; then files must be added with
``zones.append`` (or made known by ``zones.refresh``) to count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.fixed import ACTIVE, ACTIVE_LIKE, CHURNED, NOT_CHURNED
from tidemark.params import Params
from tidemark.sources import zones
from tidemark.sources.star import STAR_TABLES, STATUS_PART

# The query keys of the plain views.
PLAIN = ("churn_status", "renewal_pipeline", "monthwise_cancelled")


def relation(spark: SparkSession, star_dir: str, table: str) -> str:
    """The stored table as a relation of a FROM clause."""
    path = f"{star_dir.rstrip('/')}/{table}".replace("`", "``")
    source = f"parquet.`{path}`"
    if table == "fact_subscriptions" and STATUS_PART in spark.read.parquet(f"{star_dir.rstrip('/')}/{table}").columns:
        schema = next(s for name, s in STAR_TABLES.values() if name == table)
        columns = [c.split()[0] for c in schema.replace("(12,2)", "").split(", ")]
        given = ", ".join(f"substring({STATUS_PART}, 2) AS status" if c == "status" else c for c in columns)
        return f"(SELECT {given} FROM {source})"
    return source


def _cohort_bounds(spark: SparkSession, star_dir: str, anchors: str) -> tuple[str, str]:
    """First and last day of the year before that of the latest subscription
    start, each a scalar subquery.

    The first takes the MAX, the last the same value by its order: two plans of
    one shape would be merged into one subquery of two fields, and a field of a
    subquery is no literal to the scan.
    """
    if anchors == "zones":
        start, source = "CAST(hi AS DATE)", f"parquet.`{star_dir.rstrip('/')}/zone_map` WHERE table = 'fact_subscriptions'"
    elif anchors == "scan":
        start, source = "start_date", relation(spark, star_dir, "fact_subscriptions")
    else:
        raise ValueError(f"anchors are 'scan' or 'zones', not {anchors!r}")
    return (f"(SELECT make_date(year(max({start})) - 1, 1, 1) FROM {source})",
            f"(SELECT make_date(year(d) - 1, 12, 31) FROM (SELECT {start} AS d FROM {source}) ORDER BY d DESC NULLS LAST LIMIT 1)")


def statements(spark: SparkSession, star_dir: str, p: Params | None = None, anchors: str = "scan") -> dict[str, str]:
    """Text of each view. Of ``p`` only the renewal look-ahead is used: the
    current date is that of the reader."""
    days = (p or Params()).renewal_days
    subs = relation(spark, star_dir, "fact_subscriptions")
    accounts, products, plans = (relation(spark, star_dir, t) for t in ("dim_accounts", "dim_products", "dim_plans"))
    first, last = _cohort_bounds(spark, star_dir, anchors)
    return {
        "churn_status": f"""
SELECT account_sk,
       CASE WHEN size(s) > 0 THEN array_join(s.status, ',') END AS agg_status,
       CASE WHEN size(s) > 0 THEN array_join(transform(s, x -> concat(x.status, ':', x.n)), ',') END AS status_counts,
       CASE WHEN exists(s, x -> x.status LIKE '{ACTIVE_LIKE}') THEN '{NOT_CHURNED}' ELSE '{CHURNED}' END AS churned_status
FROM (SELECT account_sk, array_sort(collect_list(CASE WHEN status IS NOT NULL THEN struct(status, n) END)) AS s
      FROM (SELECT account_sk, status, count(*) AS n FROM {subs} WHERE account_sk IS NOT NULL GROUP BY account_sk, status)
      GROUP BY account_sk)""",
        "renewal_pipeline": f"""
SELECT s.account_sk, dp.product_name, dl.plan_name, s.status, s.renewal_date
FROM {subs} AS s JOIN {accounts} AS da ON s.account_sk = da.account_sk
JOIN {products} AS dp ON s.product_sk = dp.product_sk JOIN {plans} AS dl ON s.plan_sk = dl.plan_sk
WHERE s.status = '{ACTIVE}' AND s.renewal_date BETWEEN current_date() AND date_add(current_date(), {days})""",
        "monthwise_cancelled": f"""
SELECT CAST(coalesce(m, 0) AS INT) AS month_num, status, sub_count
FROM (SELECT month(end_date) AS m, status, count(subscription_id) AS sub_count
      FROM {subs}
      WHERE start_date BETWEEN {first} AND {last} AND (end_date IS NULL OR end_date NOT BETWEEN {first} AND {last})
      GROUP BY month(end_date), status)""",
    }


def create(spark: SparkSession, star_dir: str, p: Params | None = None, prefix: str = "", anchors: str = "scan",
           temporary: bool = True, names=PLAIN) -> list[str]:
    """Make the views over a stored star; returns their names. ``temporary=False``
    puts them into the catalog's current database."""
    if anchors == "zones":
        zones.refresh(spark, star_dir)
    kind = "TEMPORARY VIEW" if temporary else "VIEW"
    texts = statements(spark, star_dir, p, anchors)
    for name in names:
        spark.sql(f"CREATE OR REPLACE {kind} `{prefix}{name}` AS {texts[name]}")
    return [prefix + name for name in names]


def read(spark: SparkSession, star_dir: str, name: str, p: Params | None = None, anchors: str = "scan") -> DataFrame:
    """One of the views without a name for it."""
    return spark.sql(statements(spark, star_dir, p, anchors)[name])
