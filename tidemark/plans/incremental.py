"""Builds that touch only what new files change.

``update_states`` keeps the mergeable states of the usage views (operators.
usage_states) over a stored star. A manifest holds every event file that the
states contain (path, length, time) and the segment it went to; a build lists
the fact's files, never opens those it knows, and makes one segment a month
from the new ones. A file that is gone or changed takes its segment with it,
whose other files are read again. Months with many segments are merged.

``build`` refreshes all results of the report: a view is computed anew only if
what it reads changed (its tables' files, the states of its kind, its parents,
anchors or parameters), else the record of the run points to the copy that is
there. ``expire`` deletes what the last runs don't point to.

Everything new lies under names of its own and counts once the file ``CURRENT``
names it, which is replaced last: readers keep the whole earlier build, and a
build that dies leaves unused files only.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.views import stored_key
from tidemark.operators import usage_states
from tidemark.operators.usage import EVENT_MONTH
from tidemark.operators.usage_states import NUMBER, STATES
from tidemark.params import Params
from tidemark.plans.materialize import order
from tidemark.plans.plain_views import PLAIN
from tidemark.plans.registry import ALL, DEPENDS
from tidemark.sources import paths as files
from tidemark.sources import zones
from tidemark.sources.star import STAR_TABLES, Tables, read_star

_CURRENT = "CURRENT"
_MANIFEST = "path string, length bigint, modified bigint, segment string"
MOST_SEGMENTS = 8        # of one month, before they are merged


def _folder(attr: str) -> str:
    return STAR_TABLES[attr][0]


# ------------------------------------------------------------------- states

class States:
    """The states of one build: ``states(name)`` unites the segments of a state,
    ``numbers()`` gives the contacts' numbers."""

    def __init__(self, spark: SparkSession, out_dir: str, record: dict):
        self.spark, self.out_dir, self.record = spark, out_dir.rstrip("/"), record

    def __call__(self, name: str) -> DataFrame:
        paths = [f"{self.out_dir}/states/{name}/piece={s}" for s in self.record["segments"][name]]
        return self.spark.read.schema(self.record["schemas"][name]).parquet(*paths) if paths else \
            self.spark.createDataFrame([], self.record["schemas"][name])

    def numbers(self) -> DataFrame:
        schema = f"contact_sk bigint, {NUMBER} bigint"
        paths = [f"{self.out_dir}/numbers/{n}" for n in self.record["numbers"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def version(self, names) -> str:
        """Changes with the segments of the named states."""
        return hashlib.sha256(json.dumps([sorted(self.record["segments"][n]) for n in names]).encode()).hexdigest()


def _record(spark: SparkSession, out_dir: str) -> dict | None:
    mark = f"{out_dir}/{_CURRENT}"
    if not files.exists(spark, mark):
        return None
    return json.loads(files.read_text(spark, f"{out_dir}/runs/{files.read_text(spark, mark)}"))


def _month_of(path: str) -> str:
    """Partition of an event file, the name of its segments."""
    part = path.split("/")[0]
    return part.split("=", 1)[1] if part.startswith(f"{EVENT_MONTH}=") else "all"


def _events_of(t: Tables, star_dir: str, names: list[str]) -> DataFrame:
    """The events of the named files, with their month as ``part``."""
    folder = f"{star_dir}/{_folder('events')}"
    schema = STAR_TABLES["events"][1]
    if any(_month_of(n) != "all" for n in names):
        schema += f", {EVENT_MONTH} date"
    ev = t.spark.read.schema(schema).option("basePath", folder).parquet(*[files.literal(f"{folder}/{n}") for n in names])
    part = F.coalesce(F.col(EVENT_MONTH).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")) \
        if EVENT_MONTH in ev.columns else F.lit("all")
    return ev.withColumn("part", part)


def _number_contacts(ev: DataFrame, known: States, out_dir: str) -> str | None:
    """Numbers for contacts that have none, in a table of their own. Each task's
    numbers follow each other, so a word's 64 bits hold neighbours."""
    spark = ev.sparkSession
    held = known.numbers()
    new = ev.select("contact_sk").where("contact_sk IS NOT NULL").distinct().join(held, "contact_sk", "left_anti")
    after = (held.agg(F.max(NUMBER)).first()[0] if known.record["numbers"] else None) or 0
    name = f"numbers-{uuid.uuid4().hex}"
    new.withColumn(NUMBER, F.lit(after + 1) + F.monotonically_increasing_id()).write.parquet(f"{out_dir}/numbers/{name}")
    fresh = spark.read.schema(f"contact_sk bigint, {NUMBER} bigint").parquet(f"{out_dir}/numbers/{name}")
    return name if fresh.limit(1).count() else None


def _write_segments(df: DataFrame, out_dir: str, name: str, run: str) -> list[str]:
    """One segment a month; returns the segments that have rows."""
    path = f"{out_dir}/states/{name}"
    staged = df.withColumn("piece", F.concat(F.col("part"), F.lit(f"-{run}"))).drop("part")
    # Partitions of like bytes, each of one month or a few.
    staged.hint("rebalance", F.col("piece")).write.mode("append").partitionBy("piece").parquet(path)
    return [s.split("=", 1)[1] for s in files.folders(df.sparkSession, path) if s.endswith(f"-{run}")]


def update_states(spark: SparkSession, star_dir: str, out_dir: str, most_segments: int = MOST_SEGMENTS) -> dict:
    """Bring the states under ``out_dir`` up to the star's files; returns their
    record (not yet named by CURRENT: ``build`` or ``publish_states`` does that)."""
    star_dir, out_dir = star_dir.rstrip("/"), out_dir.rstrip("/")
    t = read_star(spark, star_dir)
    old = _record(spark, out_dir) or {"manifest": None, "numbers": [], "segments": {}, "schemas": {}, "dims": {}}
    run = uuid.uuid4().hex[:12]
    listed = {(f.name, f.length, f.modified) for f in files.data_files(spark, f"{star_dir}/{_folder('events')}")}
    before = {} if old["manifest"] is None else {
        (r["path"], r["length"], r["modified"]): r["segment"]
        for r in spark.read.schema(_MANIFEST).parquet(f"{out_dir}/manifests/{old['manifest']}").collect()}
    # Segments with a file that is gone or changed.
    dropped = {s for f, s in before.items() if f not in listed}
    kept = {f: s for f, s in before.items() if f in listed and s not in dropped}
    new = sorted(f for f in listed if f not in kept)
    dims = {a: files.version(spark, f"{star_dir}/{_folder(a)}") for a in ("accounts", "contacts")}

    record = {"manifest": old["manifest"], "numbers": list(old["numbers"]), "dims": dims, "segments": {}, "schemas": {}}
    known = States(spark, out_dir, old)
    names = [f[0] for f in new]
    if names:
        number = _number_contacts(_events_of(t, star_dir, names), known, out_dir)
        record["numbers"] += [number] if number else []
    numbers = States(spark, out_dir, record).numbers()
    everything = sorted(f[0] for f in listed)
    for name, state in STATES.items():
        have = [s for s in old["segments"].get(name, []) if s not in dropped]
        read = names
        empty = state.build(_no_events(t), t, numbers)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema if f.name != "part")
        if (any(old["dims"].get(d) != dims[d] for d in state.dims) or name not in old["segments"]
                or old["schemas"].get(name) != schema):
            have, read = [], everything     # its dimensions or its form changed: all of it is made anew
        record["schemas"][name] = schema
        if read:
            have = have + _write_segments(state.build(_events_of(t, star_dir, read), t, numbers), out_dir, name, run)
        record["segments"][name] = sorted(_merged(spark, out_dir, record, name, have, run, most_segments))
    if new or dropped or record["manifest"] is None:
        rows = [(*f, s) for f, s in kept.items()] + [(*f, f"{_month_of(f[0])}-{run}") for f in new]
        record["manifest"] = f"manifest-{run}"
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{out_dir}/manifests/{record['manifest']}")
    return record


def _no_events(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([], STAR_TABLES["events"][1]).withColumn("part", F.lit(""))


def _merged(spark: SparkSession, out_dir: str, record: dict, name: str, segments: list[str], run: str, most: int) -> list[str]:
    """Months in more than ``most`` segments are merged into one each."""
    months: dict[str, list[str]] = {}
    for s in segments:
        months.setdefault(_segment_month(s), []).append(s)
    crowded = {m: s for m, s in months.items() if len(s) > most}
    if not crowded:
        return segments
    out = [s for m, own in months.items() if m not in crowded for s in own]
    for month, own in crowded.items():
        part = States(spark, out_dir, {**record, "segments": {name: own}})(name)
        merged = STATES[name].merged(part).select(*part.columns)
        target = f"{month}-{run}m"
        merged.write.parquet(f"{out_dir}/states/{name}/piece={target}")
        out.append(target)
    return out


def _segment_month(segment: str) -> str:
    return segment.rsplit("-", 1)[0]


# -------------------------------------------------------------------- build

_SUBS, _ACC, _EV = "subscriptions", "accounts", "events"
# Star tables that a view reads, anchors included; the usage views read states.
READS: dict[str, tuple[str, ...]] = {
    "new_customers_by_segment": (_ACC, _SUBS, "dates"), "dim_segment_view": (_ACC,), "dim_industry_view": (_ACC,),
    "renewals_due": (_SUBS, _ACC, "products", "plans"),
    "cohort_survival": (_SUBS,), "sub_trend": (_SUBS,), "retention_cohort": (_SUBS,), "cohort_survival_calendar": (_SUBS,),
    "feature_usage_active_users": (_SUBS,), "feature_usage_adopted_users": (_SUBS,), "feature_adoption_pct": (_SUBS,),
    "adoption_rates": (_SUBS,), "kpi_feature_adoption": (_SUBS, _EV),
    "specific_page_usage": (_SUBS,), "dim_device": (), "adoption_devices": (), "kpi_device_adoption": (),
    "adoption_products": (), "product_users_by_country": (), "stickiness": (_EV,), "login_frequency": (_EV,),
    "event_depth": (_EV, _ACC, "contacts"),
}
_OTHERS = (_SUBS, _ACC, "dates")


def _key(name: str, p: Params, versions: dict[str, str], states: States, keys: dict[str, str]) -> str:
    reads = [versions[a] for a in READS.get(name, _OTHERS)]
    own = [states.version(usage_states.VIEWS[name][1])] if name in usage_states.VIEWS else []
    return hashlib.sha256(json.dumps([name, repr(p), reads, own, [keys[d] for d in DEPENDS.get(name, ())]]).encode()).hexdigest()


def view(name: str, t: Tables, p: Params, states: States) -> DataFrame:
    """The view from the states where they hold it, else from the star."""
    if name in usage_states.VIEWS:
        df = usage_states.VIEWS[name][0](t, p, states)
        if df is not None:
            return df
    return ALL[name](t, p)


def build(spark: SparkSession, star_dir: str, out_dir: str, p: Params | None = None, names=None) -> dict:
    """Refresh the results over a stored star; returns the run's record: ``views``
    (name -> key, path), ``computed`` (names of those made in this run)."""
    p, star_dir, out_dir = p or Params(), star_dir.rstrip("/"), out_dir.rstrip("/")
    zones.refresh(spark, star_dir)
    before = (_record(spark, out_dir) or {}).get("views", {})
    record = update_states(spark, star_dir, out_dir)
    states, t = States(spark, out_dir, record), read_star(spark, star_dir)
    versions = {a: files.version(spark, f"{star_dir}/{_folder(a)}") for a in STAR_TABLES}
    record |= {"views": {}, "computed": [], "params": repr(p)}
    keys: dict[str, str] = {}
    for name in [n for n in order(names or list(ALL)) if n not in PLAIN]:
        keys[name] = _key(name, p, versions, states, keys)
        found = before.get(name)
        if found is None or found["key"] != keys[name]:
            found = {"key": keys[name], "path": f"{out_dir}/views/{name}/{uuid.uuid4().hex}"}
            view(name, t, p, states).write.parquet(found["path"])
            record["computed"].append(name)
        record["views"][name] = found
        t.cache[stored_key(name, p)] = spark.read.parquet(found["path"])
    _publish(spark, out_dir, record)
    return record


def _publish(spark: SparkSession, out_dir: str, record: dict) -> None:
    run = f"run-{uuid.uuid4().hex}"
    files.write_text(spark, f"{out_dir}/runs/{run}", json.dumps(record))
    files.write_text(spark, f"{out_dir}/{_CURRENT}", run)


def publish_states(spark: SparkSession, star_dir: str, out_dir: str) -> States:
    """Bring the states up to date without building views; returns them."""
    record = update_states(spark, star_dir, out_dir) | {"views": (_record(spark, out_dir) or {}).get("views", {})}
    _publish(spark, out_dir.rstrip("/"), record)
    return States(spark, out_dir, record)


def current(spark: SparkSession, out_dir: str) -> dict:
    """The record of the last finished run."""
    return _record(spark, out_dir.rstrip("/"))


def expire(spark: SparkSession, out_dir: str, keep: int = 1) -> list[str]:
    """Delete the runs before the last ``keep`` (the current one is always kept)
    and every state, number, manifest and view that no kept run points to.
    Returns what was deleted. Not to be called while a build is under way."""
    out_dir = out_dir.rstrip("/")
    now = files.read_text(spark, f"{out_dir}/{_CURRENT}")
    runs = files.names(spark, f"{out_dir}/runs")
    kept = [now, *[r for r in runs if r != now]][:max(1, keep)]
    records = [json.loads(files.read_text(spark, f"{out_dir}/runs/{r}")) for r in kept]
    used = {f"runs/{r}" for r in kept}
    for r in records:
        used |= {f"manifests/{r['manifest']}"} | {f"numbers/{n}" for n in r["numbers"]}
        used |= {f"states/{n}/piece={s}" for n, own in r["segments"].items() for s in own}
        used |= {v["path"].removeprefix(out_dir + "/") for v in r["views"].values()}
    there = [f"runs/{n}" for n in runs]
    for top in ("manifests", "numbers"):
        there += [f"{top}/{n}" for n in files.names(spark, f"{out_dir}/{top}")]
    for top in ("states", "views"):
        there += [f"{top}/{a}/{b}" for a in files.names(spark, f"{out_dir}/{top}")
                  for b in files.names(spark, f"{out_dir}/{top}/{a}") if not b.startswith(("_", "."))]
    gone = sorted(set(there) - used)
    for name in gone:
        files.delete(spark, f"{out_dir}/{name}")
    return gone
