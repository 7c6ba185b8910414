"""Zone map: anchors of a stored star without opening its facts."""

from __future__ import annotations

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from edge_star import write_star
from tidemark.functions import anchors as A
from tidemark.plans import materialize, registry
from tidemark.sources import paths as files
from tidemark.sources import zones
from tidemark.sources.star import read_star


@pytest.fixture
def star(spark, scratch, request):
    src = write_star(spark, os.path.join(scratch, "zones-src"))
    out = os.path.join(scratch, f"zones-{request.node.name}")
    materialize.write_star(src, out)
    return out


def spoil(star: str, table: str) -> None:
    """Every data file keeps its name, length and time, but can't be read."""
    for folder, _, names in os.walk(os.path.join(star, table)):
        for n in names:
            if n.endswith(".parquet"):
                path = os.path.join(folder, n)
                st = os.stat(path)
                with open(path, "r+b") as f:
                    f.write(b"\0" * st.st_size)
                os.utime(path, ns=(st.st_atime_ns, st.st_mtime_ns))


def test_anchors_open_no_fact_file(spark, star):
    for table in ("fact_subscriptions", "fact_events", "dim_accounts"):
        spoil(star, table)
    t = read_star(spark, star)
    with pytest.raises(Exception):
        t.subscriptions.agg(F.max("start_date")).collect()
    assert A.latest_start(t) == date(2025, 7, 31)
    assert A.latest_event(t) == datetime(2025, 8, 12, 10)
    assert A.latest_created(t) == date(2025, 6, 15)


def test_files_added_by_others_are_found(spark, star):
    t = read_star(spark, star)
    row = t.subscriptions.where("subscription_id = 101").withColumn("start_date", F.lit(date(2026, 3, 5)))
    row = row.withColumn("status_part", F.lit("=Active")).drop("status")
    row.write.mode("append").partitionBy("status_part").parquet(f"{star}/fact_subscriptions")
    assert A.latest_start(read_star(spark, star)) == date(2026, 3, 5)
    # Once in the map, no file is opened again.
    assert zones.refresh(spark, star) == 1 and zones.refresh(spark, star) == 0
    spoil(star, "fact_subscriptions")
    assert A.latest_start(read_star(spark, star)) == date(2026, 3, 5)


def test_files_that_go_don_t_count(spark, star):
    newest = [f for f in files.data_files(spark, f"{star}/fact_events") if f.name.startswith("event_month=2025-08-01")]
    for f in newest:
        os.remove(f"{star}/fact_events/{f.name}")
    assert A.latest_event(read_star(spark, star)) == datetime(2025, 1, 1)


def test_append_keeps_the_map(spark, star):
    t = read_star(spark, star)
    row = t.events.where("event_sk = 1").withColumn("event_timestamp", F.lit(datetime(2025, 9, 2)).cast("timestamp_ntz"))
    row = row.withColumn("event_month", F.lit(date(2025, 9, 1)))
    assert zones.append(row, star, "fact_events", ["event_month"]) == 1
    assert zones.bounds(spark, star, "fact_events") == (datetime(2024, 12, 5), datetime(2025, 9, 2))
    names = zones.files_between(spark, star, "fact_events", datetime(2025, 8, 20), datetime(2025, 9, 30))
    assert len(names) == 1 and names[0].startswith("event_month=2025-09-01/")


def test_empty_and_null_columns(spark, scratch):
    src = write_star(spark, os.path.join(scratch, "zones-empty-src"), {"subscriptions": [], "events": []})
    out = os.path.join(scratch, "zones-empty")
    t = materialize.write_star(src, out)
    assert A.latest_start(t) is None and A.latest_event(t) is None
    assert registry.run("mrr_arr_snapshot", t).count() == 0
    accounts = [(1, "a", "b", "c", None)]
    src = write_star(spark, os.path.join(scratch, "zones-null-src"), {"accounts": accounts})
    assert A.latest_created(materialize.write_star(src, os.path.join(scratch, "zones-null"))) is None


def test_same_as_a_scan_on_the_raw_star(spark, scratch):
    from tidemark.sources.star import load_star

    raw = load_star(spark, "/root/testdata/sf0.001")
    stored = materialize.write_star(raw, os.path.join(scratch, "zones-raw"))
    assert stored.zone_bounds is not None and raw.zone_bounds is None
    for anchor in (A.latest_start, A.latest_event, A.latest_created):
        assert anchor(stored) == anchor(raw)


def test_partitions_follow_the_bytes(spark, scratch, monkeypatch):
    src = write_star(spark, os.path.join(scratch, "bytes-src"))
    held = src.input_bytes("events")
    monkeypatch.setattr(materialize, "TASK_BYTES", -(-held // 3))
    assert materialize._star_frame(src, "events")[0].rdd.getNumPartitions() == 3


PAYLOADS = ['{"page": "home"}', '{"page": 5}', '{"page": null}', '{"page": {"a": 1}}', '{"page": [1, 2]}', '{"page": ""}',
            '{"page": true}', "{}", "not json", "", None, '{"page": "home", "page2": "x"}', '{"page": "café \\"q\\""}']


def test_shredded_payload(spark, scratch):
    from tidemark.operators.usage import specific_page_usage
    from tidemark.params import Params

    events = [(i, 11, 1, 1 + i % 2, None, "page_view", "Web", "US", datetime(2024, 12, 5), p) for i, p in enumerate(PAYLOADS * 2)]
    src = write_star(spark, os.path.join(scratch, "json-src"), {"events": events})
    star = os.path.join(scratch, "json-star")
    stored = materialize.write_star(src, star)
    rows = lambda t: sorted(map(str, specific_page_usage(t, Params()).collect()))
    assert rows(stored) == rows(src) and len(rows(src)) > 10
    text = specific_page_usage(stored, Params())._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert scans and all("metadata_page#" in s and "metadata#" not in s for s in scans)
    # A file that others wrote without the typed column: the text is parsed for all.
    more = src.events.withColumn("event_sk", F.col("event_sk") + 100).withColumn("event_month", F.lit(date(2024, 12, 1)))
    more.write.mode("append").partitionBy("event_month").parquet(f"{star}/fact_events")
    both = read_star(spark, star)
    assert rows(both) != rows(src)
    counts = {r["specific_page"]: r["specific_page_views"] for r in specific_page_usage(both, Params()).where("product_sk = 1").collect()}
    assert counts == {r["specific_page"]: 2 * r["specific_page_views"] for r in specific_page_usage(src, Params()).where("product_sk = 1").collect()}
    zones.refresh(spark, star)
    assert not zones.shredded(spark, star)


def test_a_path_is_qualified_by_the_default_file_system(spark, tmp_path):
    assert files.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert files.qualified(spark, f"file://{tmp_path}/x").startswith("file:/")
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://shared/")
    conf.set("fs.viewfs.mounttable.shared.link./data", f"file://{tmp_path}")
    try:
        assert files.qualified(spark, "/data/x") == "viewfs://shared/data/x"
    finally:
        conf.set("fs.defaultFS", before)
