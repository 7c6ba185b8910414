"""Helpers shared by the operators: stored intermediates, text keys, words, numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

# Bytes that part words: ASCII outside 0-9, a-z (upper case is mapped to lower first).
_SEPARATORS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
WORD_TABLE = bytes.maketrans(
    _SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


# Rows a Python worker holds at once: whole texts are long.
ARROW_ROWS = 2000


def _bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_dir(spark: SparkSession, what: str) -> str:
    """A new folder under the shared checkpoint folder."""
    _bound_batches(spark)
    return shared_dir(spark, "tidemark-llm", f"{what}-{uuid.uuid4().hex}")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: cuts the
    lineage, survives lost executors, and later reads know its size."""
    spark = df.sparkSession
    path = run_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text) -> F.Column:
    """128 bits that stand for the text (null counts as empty)."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def word_bytes(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of 0-9, a-z and non-ASCII characters."""
    return text.encode().translate(WORD_TABLE).split() if text else []


def positions(df: DataFrame, order: list[str], what: str, group: str | None = None,
              weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` plus ``_before``: how many rows (or how much ``weight``) of the
    same ``group`` come earlier in the order of ``order``.

    Rows are range-partitioned by (group, order) and stored sorted; only the
    per-partition totals are accumulated apart (one row per partition and
    group), so no partition ever holds a whole group.
    """
    from pyspark.sql.window import Window

    keys = ([group] if group else []) + order
    cols = [F.col(k) for k in keys]
    part = (df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols))
    part = part.withColumn("_pid", F.spark_partition_id()).sortWithinPartitions("_pid", *keys)
    part = stored(part, what)
    step = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    by = ["_pid"] + ([group] if group else [])
    totals = part.groupBy(*by).agg(F.sum(step).alias("_n"))
    over_parts = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy("_pid")
    starts = totals.select(
        *by, (F.sum("_n").over(over_parts) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumn("_in", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    # One row per partition and group: the side is as large as the partition count.
    on = F.expr(" AND ".join(f"l.{c} <=> r.{c}" for c in by))
    joined = local.alias("l").join(starts.alias("r"), on, "left")
    return joined.select("l.*", (F.col("l._in") + F.col("r._start")).alias("_before")).drop("_in", "_pid")
