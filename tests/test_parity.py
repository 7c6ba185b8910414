"""Every registered query against its independent DuckDB oracle on the
driver's smallest tables (exact float comparison)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle.compare import compare, duck_for_raw
from tidemark.plans import registry

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_for_raw(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(registry.ALL) <= set(ORACLE) and set(ORACLE) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if n in registry.ALL or n.startswith(("view_", "states_", "slicer_"))))
def test_parity(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF_SMALL), con, ORACLE[name], strict=True)
    assert ok, msg


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["account_sk", "product_sk", "industry", "segment", "hq_country", "net_mrr_usd"]
    assert df.count() > 0
