"""Zone map of a stored star: the least and greatest value of the columns that
anchor the report's windows, for every data file.

The map is a small table beside the star (``zone_map``), one row per file and
column. ``bounds`` answers MIN and MAX from it: the fact's files are listed,
never opened. A file counts by its path, length and time, so a file that the
map does not know (written by others, or replaced) is found by the listing and
alone is read; rows of files that are gone are passed over. The answer is
therefore that of a full scan whoever wrote the files. The map also tells
which event files hold the shredded payload. ``refresh`` adds what the map lacks; ``files_between`` names the files that can hold a range.
"""

from __future__ import annotations

from datetime import datetime
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import paths as files

# Columns behind the anchors: table -> the column whose MAX anchors windows.
ZONED = {"fact_subscriptions": "start_date", "fact_events": "event_timestamp", "dim_accounts": "created_at"}
# The events' payload, shredded when the star is written: never NULL itself, so
# that a file written without it is told from one whose rows have no page.
SHREDDED, SHREDDED_TYPE = "metadata_page", "STRUCT<value: STRING>"
_TYPES = {"fact_subscriptions": "start_date DATE", "dim_accounts": "created_at DATE",
          "fact_events": f"event_timestamp TIMESTAMP_NTZ, {SHREDDED} {SHREDDED_TYPE}"}
_MAP = "zone_map"
_SCHEMA = ("table string, column string, file string, length bigint, modified bigint, "
           "lo timestamp_ntz, hi timestamp_ntz, n bigint, shredded boolean")


def _map_dir(star_dir: str) -> str:
    return f"{star_dir.rstrip('/')}/{_MAP}"


def has_map(spark: SparkSession, star_dir: str) -> bool:
    return files.exists(spark, _map_dir(star_dir))


def read_map(spark: SparkSession, star_dir: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(_map_dir(star_dir))


def _relative(uri: str, table_dir: str) -> str:
    """Path of a file below its table's folder, as the listing gives it."""
    path = unquote(urlparse(uri).path) if "://" in uri or uri.startswith("file:") else uri
    return path.split(f"/{table_dir.rstrip('/').rsplit('/', 1)[1]}/", 1)[1]


def _described(spark: SparkSession, star_dir: str, table: str, listed: list) -> list[tuple]:
    """Map rows of the listed files: one aggregate over the one column."""
    if not listed:
        return []
    column, folder = ZONED[table], f"{star_dir.rstrip('/')}/{table}"
    known = {f.name: f for f in listed}
    df = spark.read.schema(_TYPES[table]).option("basePath", folder).parquet(*[files.literal(f"{folder}/{f.name}") for f in listed])
    ntz = F.col(column).cast("timestamp_ntz")
    shredded = F.col(SHREDDED).isNotNull() if table == "fact_events" else F.lit(True)
    found = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(ntz).alias("lo"), F.max(ntz).alias("hi"), F.count(F.lit(1)).alias("n"),
        F.min(shredded).alias("shredded")).collect()
    out, seen = [], set()
    for r in found:
        name = _relative(r["file"], folder)
        seen.add(name)
        out.append((table, column, name, known[name].length, known[name].modified, r["lo"], r["hi"], r["n"],
                    r["shredded"]))
    # Files without rows.
    return out + [(table, column, f.name, f.length, f.modified, None, None, 0, True) for f in listed if f.name not in seen]


def _entries(spark: SparkSession, star_dir: str, table: str) -> tuple[list[tuple], list]:
    """(the map's rows of files that are there, files that the map lacks)."""
    listed = files.data_files(spark, f"{star_dir.rstrip('/')}/{table}")
    state = {(f.name, f.length, f.modified) for f in listed}
    rows = []
    if has_map(spark, star_dir):
        rows = [tuple(r) for r in read_map(spark, star_dir).where(F.col("table") == table).collect()
                if (r["file"], r["length"], r["modified"]) in state]
    mapped = {(r[2], r[3], r[4]) for r in rows}
    return rows, [f for f in listed if (f.name, f.length, f.modified) not in mapped]


def refresh(spark: SparkSession, star_dir: str, tables=None) -> int:
    """Add the files that the map lacks; returns how many they were."""
    added = []
    for table in tables or ZONED:
        added += _described(spark, star_dir, table, _entries(spark, star_dir, table)[1])
    if added or not has_map(spark, star_dir):
        spark.createDataFrame(added, _SCHEMA).coalesce(1).write.mode("append").parquet(_map_dir(star_dir))
    return len(added)


def zones(spark: SparkSession, star_dir: str, table: str) -> list[tuple]:
    """Map rows of all files that are there; those that the map lacks are read for it."""
    rows, missing = _entries(spark, star_dir, table)
    return rows + _described(spark, star_dir, table, missing)


def bounds(spark: SparkSession, star_dir: str, table: str) -> tuple[datetime | None, datetime | None]:
    """(MIN, MAX) of the table's zoned column."""
    rows = [r for r in zones(spark, star_dir, table) if r[5] is not None]
    return (min((r[5] for r in rows), default=None), max((r[6] for r in rows), default=None))


def files_between(spark: SparkSession, star_dir: str, table: str, lo, hi) -> list[str]:
    """Files, relative to the table's folder, that can hold a value of [lo, hi]."""
    return sorted(r[2] for r in zones(spark, star_dir, table) if r[5] is not None and r[6] >= lo and r[5] <= hi)


def shredded(spark: SparkSession, star_dir: str) -> bool:
    """Whether every event file has the shredded payload (files that the map lacks
    are looked into)."""
    return all(r[8] for r in zones(spark, star_dir, "fact_events"))


def append(df: DataFrame, star_dir: str, table: str, partition_by=()) -> int:
    """Add rows to a stored table and its files to the map; returns the number of new files."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{star_dir.rstrip('/')}/{table}")
    return refresh(df.sparkSession, star_dir, [table]) if table in ZONED else 0
