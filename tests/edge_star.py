"""Hand-built star tables for cases the synthetic data never has.

Anchors: D = MAX(start_date) = 2025-07-31; T = MAX(event_timestamp) =
2025-08-12 10:00:00; as_of = 2025-08-01.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from tidemark.sources.star import STAR_TABLES, Tables, dim_date

d, ts, M = date, datetime, Decimal

ACCOUNTS = [
    # account_sk, segment, industry, hq_country, created_at
    (1, "Enterprise", "IND_1", "US", d(2025, 3, 1)),
    (2, "SMB", "IND_2", "DE", d(2024, 5, 1)),
    (3, "SMB", "IND_1", "US", d(2025, 6, 15)),
    (4, "Enterprise", "IND_3", "FR", d(2025, 2, 1)),   # no subscriptions
    (5, "Mid", "IND_2", "US", d(2023, 1, 1)),
    (6, None, "IND_4", None, d(2025, 1, 10)),          # NULL attributes
    (7, "SMB", "IND_5", "IT", d(2025, 4, 1)),          # only NULL statuses
]

SUBS = [
    # id, account, product, plan, start, end, status, renewal, mrr, commit, prov, auto
    (101, 1, 1, 1, d(2024, 3, 1), None, "Active", d(2025, 8, 1), M("100.00"), 10, 8, True),
    (102, 1, 2, 2, d(2025, 7, 31), None, "Active", d(2025, 10, 30), M("50.10"), 5, 5, False),
    (103, 1, 1, 1, d(2024, 5, 10), d(2025, 2, 15), "Cancelled", d(2025, 10, 31), M("30.00"), 3, 2, None),
    (104, 2, 1, 1, d(2024, 6, 1), d(2025, 10, 5), "Cancelled", d(2025, 9, 1), M("40.00"), 4, 4, True),
    (105, 2, 3, 3, d(2024, 1, 15), d(2024, 11, 30), "Cancelled", d(2025, 9, 2), M("25.00"), 2, 1, True),
    (106, 3, 2, 1, d(2024, 7, 1), None, "Cancelled", d(2025, 9, 3), M("15.00"), 1, 1, False),
    (107, 3, 2, 2, d(2024, 12, 31), d(2026, 1, 20), "Cancelled", d(2025, 9, 4), M("12.50"), 2, 2, True),
    (108, 5, 1, 1, d(2024, 2, 1), None, "Inactive", d(2025, 9, 5), M("9.99"), 6, 3, True),
    (110, None, 1, 1, d(2024, 4, 1), None, "Active", d(2025, 8, 20), M("5.00"), 1, 1, True),
    (111, 6, 4, 1, d(2024, 12, 15), d(2025, 12, 1), "Active", d(2025, 9, 6), M("20.00"), 7, 7, True),
    (112, 6, 4, 1, d(2023, 1, 1), None, None, d(2025, 9, 7), M("8.00"), 3, 3, False),
    (113, 2, 2, 3, d(2024, 7, 15), None, "Active", d(2025, 11, 30), M("0.01"), 2, 2, True),
    (114, 1, 3, 1, d(2024, 7, 1), None, "Active", d(2025, 8, 15), M("70.00"), 8, 6, True),
    (115, 3, 1, 2, d(2024, 10, 10), d(2025, 11, 20), "Cancelled", d(2025, 9, 8), M("11.00"), 1, 1, True),
    (116, 2, 1, 1, d(2024, 9, 1), d(2025, 12, 3), "Cancelled", d(2025, 9, 9), M("13.00"), 2, 2, True),
    (117, 2, 2, 9, d(2024, 3, 3), None, "Active", d(2025, 8, 2), M("3.00"), 1, 1, True),  # plan 9 orphan
    (118, 2, 1, 1, d(2025, 1, 5), None, "Paused", d(2025, 9, 10), M("2.00"), 1, 0, True),
    (119, 7, 3, 2, d(2024, 5, 5), None, None, d(2025, 9, 11), M("1.00"), 1, 1, None),
]

EVENTS = [
    # event_sk, contact, account, product, feature, type, device, country, timestamp, metadata
    (1, 11, 1, 1, 3, "feature_use", "Web", "US", ts(2025, 8, 12, 10, 0, 0), '{"page": "home"}'),
    (2, 11, 1, 2, 4, "feature_use", "iOS", "US", ts(2025, 8, 3, 9, 0), '{"page": "home"}'),
    (3, 12, 1, 1, None, "export", "Android", "US", ts(2025, 8, 12, 8, 0), "{}"),
    (4, 21, 2, None, 1, "feature_use", "Web", "DE", ts(2025, 8, 12, 9, 0), "{}"),
    (5, 21, 2, 1, None, None, "Web", "DE", ts(2025, 8, 5), "{}"),
    (6, 31, 3, 1, 3, "feature_use", "Web", "US", ts(2024, 12, 31, 0, 0, 0), "{}"),
    (7, 31, 3, 1, None, "export", "iOS", "US", ts(2024, 12, 31, 0, 0, 1), "{}"),
    (8, 11, 1, 1, None, "login", "Web", "US", ts(2024, 12, 5), "{}"),
    (9, 12, 1, 1, None, "login", "Web", "US", ts(2024, 12, 20), "{}"),
    (10, 11, 1, 1, None, "login", "iOS", "US", ts(2024, 12, 21), "{}"),
    (11, 21, 2, 2, None, "page_view", "Web", "DE", ts(2024, 12, 10), '{"page": "pricing"}'),
    (12, 21, 2, 2, None, "page_view", "Web", "DE", ts(2024, 12, 11), '{"other": 1}'),
    (13, 51, 5, 2, None, "page_view", "iOS", "US", ts(2024, 12, 31, 23, 59, 59), '{"page": "pricing"}'),
    (14, 99, 9, 1, 3, "feature_use", "Web", "NL", ts(2025, 8, 12, 7, 0), "{}"),
    (15, 11, 1, 1, 3, "feature_use", "Web", "US", ts(2024, 12, 15), "{}"),
    (16, 12, 1, 1, None, "page_view", "Web", "US", ts(2025, 1, 1, 0, 0, 0), '{"page": "home"}'),
    (17, 12, 1, 1, 2, "export", "Web", "US", ts(2025, 8, 10), "{}"),   # feature set, not feature_use
    (18, 21, 2, 1, 3, "feature_use", "Android", "DE", ts(2025, 8, 11), "{}"),
]

CONTACTS = [(11, 1), (12, 1), (21, 2), (31, 3), (51, 5)]
PRODUCTS = [(1, "Analytics Pro"), (2, "Insight Lite"), (3, "Data Hub"), (4, "Edge")]
PLANS = [(1, "Starter"), (2, "Growth"), (3, "Scale")]

ROWS = {"accounts": ACCOUNTS, "subscriptions": SUBS, "events": EVENTS,
        "contacts": CONTACTS, "products": PRODUCTS, "plans": PLANS}


def write_star(spark, out_dir: str, rows: dict | None = None) -> Tables:
    """Write the star (given rows, defaults above) as parquet folders named as
    in the report SQL and return Tables reading them."""
    from tidemark.sources.star import read_star

    rows = {**ROWS, **(rows or {})}
    for attr, (table, schema) in STAR_TABLES.items():
        if attr == "dates":
            df = dim_date(spark, date(2019, 1, 1), date(2026, 12, 31))
        else:
            df = spark.createDataFrame(rows[attr], schema)
        df.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/{table}")
    return read_star(spark, out_dir)


STAR_NAMES = [table for table, _ in STAR_TABLES.values()]
