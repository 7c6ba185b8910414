"""Write the star schema and every view out as parquet, parents first.

``build_all`` is the batch refresh of the report: (1) the star is written
once, laid out for the views' filters, and read back (so every view scans
stored, pruned, pushed-down parquet instead of re-deriving from raw tables);
(2) each view is written in dependency order, and views built on views read
their parent's stored copy (a consistent snapshot and a short lineage). The
report's plain views (plans.plain_views) are not stored: they are SQL views over
the star, evaluated at every read.

Layout of the stored star:

* ``fact_events``: partitioned by ``event_month`` (first day of the event's
  month) and range-clustered by (event_timestamp, event_sk) before writing, so
  each task writes a contiguous time slice (few files per month, time-sorted
  row groups) and the views' month windows prune partitions and row groups.
  The secondary key splits a timestamp that holds many rows. The payload's page
  is shredded into a typed column beside the text.
* ``fact_subscriptions``: partitioned by the status (most views filter on it),
  marked with ``=`` so that an empty status stays apart from NULL, and sorted
  by (start_date, subscription_id), so start-date bounds skip row groups.
* dimensions: written as they are.
* ``zone_map``: least and greatest anchor value of every file (sources.zones),
  so the anchors of later builds and views are looked up without a scan.

Every build goes to a run folder of its own; the file ``CURRENT`` names the
last finished one and is replaced at the end, so readers keep a whole, unchanged
snapshot meanwhile. A run records what it was built from (Params and the state
of the input files). With ``resume=True`` a rerun continues the newest run of
the same key and skips outputs that have their ``_SUCCESS`` marker; any other
Params or input start a new run. Paths may be URIs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fixed import PAGE_PATH
from tidemark.functions.views import stored_key
from tidemark.operators.usage import EVENT_MONTH
from tidemark.params import Params
from tidemark.plans.plain_views import PLAIN
from tidemark.plans.registry import ALL, DEPENDS
from tidemark.session import shared_dir
from tidemark.sources import paths as files
from tidemark.sources import zones
from tidemark.sources.star import STAR_TABLES, STATUS_PART, Tables, read_star


_KEY, _CURRENT = "KEY", "CURRENT"
_EMPTY_PARTITION = {EVENT_MONTH: f"{EVENT_MONTH}=1970-01-01", STATUS_PART: f"{STATUS_PART}=%3D"}


def _done(spark, path: str) -> bool:
    return files.exists(spark, f"{path}/_SUCCESS")


# Stored input bytes behind what a task sorts and writes of a fact, whatever the cluster's cores: the star's rows
# take some 30 times as much in the sort (measured: 1.7 M events of 13 MB stored, 403 MB).
TASK_BYTES = 16 << 20


def _ranged(t: Tables, attr: str, df: DataFrame, keys) -> DataFrame:
    """``df`` in ranges of ``keys``, as many as its input's bytes ask for."""
    held = t.input_bytes(attr)
    return df.repartitionByRange(*keys) if held is None else df.repartitionByRange(max(1, -(-held // TASK_BYTES)), *keys)


def _star_frame(t: Tables, attr: str) -> tuple[DataFrame, list[str]]:
    df = getattr(t, attr)
    if attr == "events":
        ts = F.col("event_timestamp")
        df = df.withColumn(EVENT_MONTH, F.make_date(F.year(ts), F.month(ts), F.lit(1))).withColumn(
            zones.SHREDDED, F.struct(F.get_json_object("metadata", PAGE_PATH).alias("value")))
        df = _ranged(t, attr, df, [ts, F.col("event_sk")]).sortWithinPartitions(EVENT_MONTH, ts, "event_sk")
        return df, [EVENT_MONTH]
    if attr == "subscriptions":
        # Marked, since partition values cannot tell an empty string from NULL.
        df = df.withColumn(STATUS_PART, F.concat(F.lit("="), F.col("status"))).drop("status")
        keys = [F.col("start_date"), F.col("subscription_id")]
        return _ranged(t, attr, df, keys).sortWithinPartitions(STATUS_PART, *keys), [STATUS_PART]
    return df, []


def write_star(t: Tables, out_dir: str, resume: bool = False) -> Tables:
    """Write the star tables under ``out_dir`` and return Tables reading them."""
    for attr, (table, _) in STAR_TABLES.items():
        path = f"{out_dir.rstrip('/')}/{table}"
        if resume and _done(t.spark, path):
            continue
        df, parts = _star_frame(t, attr)
        writer = df.write.mode("overwrite")
        if parts:
            writer = writer.partitionBy(*parts)
        writer.parquet(path)
        if parts and not files.data_files(t.spark, path):
            # No row, no partition: an empty file keeps the table's columns readable.
            df.drop(*parts).limit(0).write.mode("append").parquet(f"{path}/{_EMPTY_PARTITION[parts[0]]}")
    zones.refresh(t.spark, out_dir)
    return read_star(t.spark, out_dir)


def order(names) -> list[str]:
    """Topological order of the given keys plus their parents."""
    seen: list[str] = []

    def visit(name: str, stack: tuple = ()):
        if name in seen:
            return
        if name in stack:
            raise ValueError(f"dependency cycle at {name}")
        for dep in DEPENDS.get(name, ()):
            visit(dep, stack + (name,))
        seen.append(name)

    for n in names:
        visit(n)
    return seen


def build_views(t: Tables, p: Params, out_dir: str, names=None, resume: bool = False) -> dict[str, str]:
    """Write views (default: all registered keys) in dependency order; each
    written view is then read from storage by its children. Plain views are
    never stored."""
    spark = t.spark
    paths = {}
    for name in [n for n in order(names or list(ALL)) if n not in PLAIN]:
        path = f"{out_dir.rstrip('/')}/{name}"
        if not (resume and _done(spark, path)):
            ALL[name](t, p).write.mode("overwrite").parquet(path)
        t.cache[stored_key(name, p)] = spark.read.parquet(path)
        paths[name] = path
    return paths


def build_all(t: Tables, p: Params | None = None, out_dir: str | None = None,
              names=None, resume: bool = False) -> dict[str, str]:
    """Store the star, then every view, in a run folder under ``out_dir``
    (default: a folder under the cluster's shared ``spark.checkpoint.dir``)."""
    p = p or Params()
    out_dir = (out_dir or shared_dir(t.spark, "tidemark")).rstrip("/")
    key = f"{p!r}\n{t.version()}"
    run = None
    if resume:
        for name in files.folders(t.spark, out_dir):
            mark = f"{out_dir}/{name}/{_KEY}"
            if files.exists(t.spark, mark) and files.read_text(t.spark, mark) == key:
                run = name
                break
    if run is None:
        run = f"run-{uuid.uuid4().hex}"
        files.write_text(t.spark, f"{out_dir}/{run}/{_KEY}", key)
    stored = write_star(t, f"{out_dir}/{run}/star", resume=True)
    paths = build_views(stored, p, f"{out_dir}/{run}/views", names=names, resume=True)
    files.write_text(t.spark, f"{out_dir}/{_CURRENT}", run)
    return paths


def current(spark, out_dir: str) -> str:
    """The folder of the last finished build under ``out_dir``."""
    out_dir = out_dir.rstrip("/")
    return f"{out_dir}/{files.read_text(spark, f'{out_dir}/{_CURRENT}')}"


def current_star(spark, path: str) -> str:
    """The star of the last finished build, or ``path`` if it is a star itself."""
    here = path.rstrip("/")
    return f"{current(spark, here)}/star" if files.exists(spark, f"{here}/{_CURRENT}") else here
