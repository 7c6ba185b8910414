"""Queries that SQL can express, against DuckDB on the smallest tables."""
import pytest

from oracle.compare import compare, duck_for_raw
from tidemark.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_parity(spark, name):
    ok, message = compare(queries.QUERIES[name](spark, SMALL), duck_for_raw(SMALL), queries.ORACLE_SQL[name], strict=True)
    assert ok, message


def test_all_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
