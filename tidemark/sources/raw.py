"""Readers for the driver's raw parquet tables.

Each table is read with an explicit schema holding only the columns the star
schema needs: no footer inference at planning time, and the parquet scan's
``ReadSchema`` is pruned to these columns. A file whose column types differ
fails at scan time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_SCHEMAS: dict[str, str] = {
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING",
    "region": "r_regionkey INT, r_name STRING",
    "part": "p_partkey BIGINT, p_name STRING",
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
               "o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ"),
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING",
}


def table_path(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"


def read_raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[table]).parquet(table_path(sf_dir, table))
