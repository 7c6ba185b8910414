"""States that add up, and builds that touch only what changed."""

from __future__ import annotations

import os
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from edge_star import EVENTS, write_star
from oracle.compare import norm
from tidemark.operators import usage_states
from tidemark.operators.usage_states import STATES, whole_days
from tidemark.params import Params
from tidemark.plans import incremental, materialize
from tidemark.plans.plain_views import PLAIN
from tidemark.plans.registry import ALL
from tidemark.sources import zones
from tidemark.sources.star import read_star


def multiset(df):
    cols = sorted(df.columns)
    return Counter(tuple(norm(r[c], True) for c in cols) for r in df.select(*cols).collect())


def files_under(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def month_of_events(spark, star, first_sk, month):
    """The events again, with other keys, in another month, by other contacts too."""
    rows = read_star(spark, star).events.where("event_sk < 100")
    rows = rows.withColumn("event_sk", F.col("event_sk") + first_sk).withColumn(
        "event_timestamp", F.make_timestamp_ntz(F.lit(month.year), F.lit(month.month), F.lit(1) + F.col("event_sk") % 20,
                                                F.lit(7), F.lit(0), F.lit(0))).withColumn(
        "contact_sk", F.when(F.col("event_sk") % 2 == 0, F.lit(51)).otherwise(F.col("contact_sk")))
    rows = rows.withColumn("event_month", F.lit(month))
    return spark.createDataFrame(rows.collect(), rows.schema)


def same_views(spark, star, states, p=None, names=usage_states.VIEWS):
    p = p or Params()
    t = read_star(spark, star)
    for name in names:
        got, direct = incremental.view(name, t, p, states), ALL[name](t, p)
        assert got.schema.simpleString() == direct.schema.simpleString(), name
        assert multiset(got) == multiset(direct), name


# One view of each kind of state: bits alone, bits with flags, sums with days.
SOME = ("adoption_devices", "adoption_products", "event_depth")


@pytest.fixture(scope="module")
def star(spark, scratch):
    out = os.path.join(scratch, "states-star")
    # Events without contact, device or account beside the edge cases.
    more = [(50, None, 1, 1, 3, "feature_use", "Web", "US", datetime(2025, 8, 1), "{}"),
            (51, None, 1, 9, 3, "feature_use", "TV", "US", datetime(2025, 8, 2), "{}"),
            (52, 12, 1, 1, 3, "feature_use", None, None, datetime(2025, 8, 2), None),
            (53, 12, None, 1, 3, "login", "Web", "US", datetime(2024, 12, 2), "{}"),
            (54, None, 1, 1, None, "login", "Web", "US", datetime(2024, 12, 2), "{}"),
            (55, 2 ** 40, 2, 1, None, None, "Web", "US", datetime(2024, 12, 30, 23, 59, 59, 999999), "{}")]
    materialize.write_star(write_star(spark, os.path.join(scratch, "states-src"), {"events": EVENTS + more}), out)
    return out


def test_views_from_states(spark, scratch, star):
    states = incremental.publish_states(spark, star, os.path.join(scratch, "states-a"))
    same_views(spark, star, states)
    # A window that cuts days at both ends, one within a day, an empty one.
    for lo, hi in ((datetime(2024, 12, 10, 12), datetime(2025, 8, 12, 8)), (datetime(2025, 8, 12, 7), datetime(2025, 8, 12, 9)),
                   (datetime(2024, 12, 31), datetime(2024, 12, 31, 0, 0, 1)), (datetime(2025, 1, 2), datetime(2025, 1, 1))):
        same_views(spark, star, states, Params(depth_start=lo, depth_end=hi), ["event_depth"])
    same_views(spark, star, states, Params(slicers={"product_sk": 1}), ["kpi_device_adoption"])
    same_views(spark, star, states, Params(slicers={"segment": "SMB"}), ["kpi_device_adoption"])


def test_device_counts_read_no_event(spark, scratch, star):
    """K14 from V27's bits: the events can be gone."""
    from test_zones import spoil

    own = os.path.join(scratch, "states-spoiled")
    materialize.write_star(read_star(spark, star), own)
    states = incremental.publish_states(spark, own, os.path.join(scratch, "states-spoiled-out"))
    expected = multiset(ALL["kpi_device_adoption"](read_star(spark, own), Params()))
    spoil(own, "fact_events")
    assert multiset(incremental.view("kpi_device_adoption", read_star(spark, own), Params(), states)) == expected


def test_a_month_more_touches_its_segments_only(spark, scratch):
    star, out = os.path.join(scratch, "grow-star"), os.path.join(scratch, "grow-out")
    materialize.write_star(write_star(spark, os.path.join(scratch, "grow-src")), star)
    first = incremental.build(spark, star, out)
    assert set(first["computed"]) == set(ALL) - set(PLAIN) and set(first["views"]) == set(first["computed"])
    assert incremental.build(spark, star, out)["computed"] == []
    before = files_under(f"{out}/states")

    zones.append(month_of_events(spark, star, 1000, date(2025, 9, 1)), star, "fact_events", ["event_month"])
    second = incremental.build(spark, star, out)
    new = files_under(f"{out}/states") - before
    assert new and all("piece=2025-09-01-" in n for n in new)
    assert before <= files_under(f"{out}/states")
    # Views of subscriptions and accounts stay as they are, those of events are new.
    assert set(usage_states.VIEWS) - {"specific_page_usage"} <= set(second["computed"])
    assert not {"mrr_arr_snapshot", "acv", "kpi_nrr", "dim_segment_view", "cohort_survival"} & set(second["computed"])
    for name in {*second["computed"], "mrr_arr_snapshot", "kpi_nrr"}:
        held = spark.read.parquet(second["views"][name]["path"])
        assert multiset(held) == multiset(ALL[name](read_star(spark, star), Params())), name

    # The last two runs are kept, what only the first had goes.
    third = incremental.build(spark, star, out, Params(as_of=date(2025, 10, 1)))
    assert "renewals_due" in third["computed"]
    gone = incremental.expire(spark, out, keep=2)
    assert gone and any(g.startswith("views/stickiness/") for g in gone)
    for r in (second, third):
        assert all(os.path.exists(v["path"]) for v in r["views"].values())
    incremental.expire(spark, out)
    assert all(os.path.exists(v["path"]) for v in third["views"].values())
    assert incremental.build(spark, star, out, Params(as_of=date(2025, 10, 1)))["computed"] == []
    assert incremental.current(spark, out)["views"] == third["views"]


def test_files_that_go_or_change(spark, scratch):
    star, out = os.path.join(scratch, "gone-star"), os.path.join(scratch, "gone-out")
    materialize.write_star(write_star(spark, os.path.join(scratch, "gone-src")), star)
    for k in range(2):      # two files in one month
        zones.append(month_of_events(spark, star, 1000 + 100 * k, date(2025, 9, 1)), star, "fact_events", ["event_month"])
    incremental.publish_states(spark, star, out)
    month = f"{star}/fact_events/event_month=2025-09-01"
    data = sorted(n for n in os.listdir(month) if n.endswith(".parquet"))
    os.remove(os.path.join(month, data[0]))
    states = incremental.publish_states(spark, star, out)
    same_views(spark, star, states, names=SOME)
    # The file that stayed was read again, into a segment of its own.
    assert sum("2025-09-01" in s for s in states.record["segments"]["devices"]) == 1


def test_changed_dimensions_make_their_states_anew(spark, scratch):
    star, out = os.path.join(scratch, "dims-star"), os.path.join(scratch, "dims-out")
    materialize.write_star(write_star(spark, os.path.join(scratch, "dims-src")), star)
    first = incremental.publish_states(spark, star, out).record["segments"]
    spark.createDataFrame([(9, "New", "IND_9", "NL", date(2025, 1, 1))], read_star(spark, star).accounts.schema).write.mode(
        "append").parquet(f"{star}/dim_accounts")
    states = incremental.publish_states(spark, star, out)
    same_views(spark, star, states, names=SOME)
    changed = {n for n in STATES if states.record["segments"][n] != first[n]}
    assert changed == {n for n, s in STATES.items() if "accounts" in s.dims}


def test_many_segments_of_a_month_are_merged(spark, scratch):
    star, out = os.path.join(scratch, "many-star"), os.path.join(scratch, "many-out")
    materialize.write_star(write_star(spark, os.path.join(scratch, "many-src")), star)
    for k in range(3):
        zones.append(month_of_events(spark, star, 1000 + 100 * k, date(2025, 9, 1)), star, "fact_events", ["event_month"])
        record = incremental.update_states(spark, star, out, most_segments=2)
        incremental._publish(spark, out, record | {"views": {}})
    states = incremental.States(spark, out, record)
    assert sum("2025-09-01" in s for s in record["segments"]["devices"]) == 1
    same_views(spark, star, states, names=SOME)
    # A file of a merged segment that goes takes the merged segment with it.
    month = f"{star}/fact_events/event_month=2025-09-01"
    os.remove(os.path.join(month, sorted(n for n in os.listdir(month) if n.endswith(".parquet"))[0]))
    same_views(spark, star, incremental.publish_states(spark, star, out), names=SOME)


def test_no_events(spark, scratch):
    star, out = os.path.join(scratch, "none-star"), os.path.join(scratch, "none-out")
    materialize.write_star(write_star(spark, os.path.join(scratch, "none-src"), {"events": []}), star)
    same_views(spark, star, incremental.publish_states(spark, star, out), names=SOME)


def test_reads_names_every_table_of_a_view(spark, scratch, star):
    """What a view asks of the star, traced, is what its key covers."""
    states = incremental.publish_states(spark, star, os.path.join(scratch, "states-a"))
    for name in set(ALL) - set(PLAIN):
        t = read_star(spark, star)
        asked = set()
        plain = type(t).__getattr__

        class Traced(type(t)):
            def __getattr__(self, attr):
                if attr in self.NAMES:
                    asked.add(attr)
                return plain(self, attr)

        t.__class__ = Traced
        bounds = t.zone_bounds
        t.zone_bounds = lambda table: asked.add({v[0]: k for k, v in _tables().items()}[table]) or bounds(table)
        incremental.view(name, t, Params(), states)
        covered = set(incremental.READS.get(name, incremental._OTHERS))
        assert asked <= covered, (name, asked - covered)


def _tables():
    from tidemark.sources.star import STAR_TABLES

    return STAR_TABLES


def test_whole_days():
    day = lambda m, d, *t: datetime(2024, m, d, *t)
    assert whole_days(day(12, 1), day(12, 31)) == (date(2024, 12, 1), date(2024, 12, 30), [(day(12, 31), day(12, 31))])
    end = day(12, 31, 23, 59, 59, 999999)
    assert whole_days(day(12, 1), end) == (date(2024, 12, 1), date(2024, 12, 31), [])
    first, last, cut = whole_days(day(12, 1, 5), day(12, 3, 5))
    assert (first, last) == (date(2024, 12, 2), date(2024, 12, 2))
    assert cut == [(day(12, 1, 5), day(12, 1, 23, 59, 59, 999999)), (day(12, 3), day(12, 3, 5))]
    assert whole_days(day(12, 1, 5), day(12, 1, 6))[2] == [(day(12, 1, 5), day(12, 1, 6))]
    assert whole_days(day(12, 1, 6), day(12, 1, 5))[2] == []
    first, last, cut = whole_days(day(12, 1, 5), day(12, 2, 5))
    assert first > last and cut == [(day(12, 1, 5), day(12, 2, 5))]


def test_a_state_row_is_a_word_however_sparse_the_contacts(spark, scratch):
    """Contacts far apart in number take a word each, and no sort: the states' size follows their contacts."""
    from tidemark.operators.usage_states import NUMBER, bit_of, bucket_of

    rows = spark.createDataFrame([(1, n) for n in (1, 63, 64, 40_000, 2 ** 40)] + [(1, None)], f"k int, {NUMBER} bigint")
    bits = rows.groupBy("k", bucket_of(NUMBER).alias("bucket")).agg(usage_states.any_bits(bit_of(NUMBER)).alias("users"))
    assert dict(bits.dtypes)["users"] == "bigint"
    assert {r["bucket"]: r["users"] for r in bits.collect()} == {
        0: 2 - 2 ** 63, 1: 1, 625: 1, 2 ** 34: 1, None: 0}
    assert usage_states.contacts_in(bits, ["k"], n="users").first()["n"] == 5

    star, out = os.path.join(scratch, "word-star"), os.path.join(scratch, "word-out")
    t = materialize.write_star(write_star(spark, os.path.join(scratch, "word-src")), star)
    states = incremental.publish_states(spark, star, out)
    for name, state in STATES.items():
        assert all(dict(states(name).dtypes)[c] == "bigint" for c in state.bits), name
        if state.bits:
            plan = state.build(t.events.withColumn("part", F.lit("")), t, states.numbers())._jdf.queryExecution().toString()
            assert "SortAggregate" not in plan, name


def test_states_of_another_form_are_made_anew(spark, scratch):
    """A record whose states were stored with other columns is not read as this one."""
    star, out = os.path.join(scratch, "form-star"), os.path.join(scratch, "form-out")
    materialize.write_star(write_star(spark, os.path.join(scratch, "form-src")), star)
    record = incremental.publish_states(spark, star, out).record
    old = {**record["schemas"], "devices": record["schemas"]["devices"].replace("`users` bigint", "`users` binary")}
    incremental._publish(spark, out, record | {"schemas": old})
    states = incremental.publish_states(spark, star, out)
    changed = {n for n in STATES if states.record["segments"][n] != record["segments"][n]}
    assert changed == {"devices"}
    same_views(spark, star, states, names=SOME)


def test_a_task_of_the_star_build_has_a_bounded_share(spark, scratch, monkeypatch):
    """A fact of 100 MB stored is sorted and written by several tasks, each with 16 MB of it."""
    t = read_star(spark, write_star(spark, os.path.join(scratch, "share-src")).source)
    monkeypatch.setattr(t, "input_bytes", lambda attr: 100 << 20)
    df, _ = materialize._star_frame(t, "events")
    assert df.rdd.getNumPartitions() == 7
