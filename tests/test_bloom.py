"""The Bloom filter of active pairs on the event scan."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from edge_star import write_star
from oracle.compare import norm
from tidemark.functions import bloom
from tidemark.operators import usage
from tidemark.params import Params
from tidemark.sources.star import load_star, read_star


def test_every_key_passes_and_few_others(spark):
    keys = spark.range(20_000).select((F.col("id") * 7).alias("a"), F.concat(F.lit("k"), F.col("id") % 13).alias("b"))
    found = bloom.build(keys, ["a", "b"])
    assert found.n == 20_000 and found.size >= found.n * bloom.BITS_PER_KEY
    assert keys.where(found.may_hold("a", "b")).count() == 20_000
    others = keys.withColumn("a", F.col("a") + 1)
    assert others.where(found.may_hold("a", "b")).count() < 0.02 * 20_000


def test_nulls_empty_and_too_many(spark):
    keys = spark.createDataFrame([(1, 2), (3, None), (None, None)], "a long, b long")
    found = bloom.build(keys, ["a", "b"])
    assert keys.where(found.may_hold("a", "b")).count() == 3
    none = bloom.build(keys.limit(0), ["a", "b"])
    assert none.n == 0 and keys.where(none.may_hold("a", "b")).count() == 0
    assert bloom.build(spark.range(1000).toDF("a"), ["a"], most_bits=1 << 12) is None


def test_filter_stands_below_the_first_exchange(spark):
    t = load_star(spark, "/root/testdata/sf0.001")
    df = usage.feature_adoption_pct(t, Params())
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "event_id" in line)
    above = lines[:scan]
    at = max(i for i, line in enumerate(above) if "getbit" in line)
    assert max(i for i, line in enumerate(above) if "Exchange hashpartitioning" in line) < at


def test_shuffled_triples_shrink_to_the_matching(spark):
    t, p = load_star(spark, "/root/testdata/sf0.01"), Params()
    every = t.events.where("feature_sk IS NOT NULL").select("account_sk", "product_sk", "feature_sk").distinct().count()
    kept = usage.feature_triples(t, p).count()
    matching = usage.adopted_triples(t, p).count()
    assert matching <= kept <= matching + 0.02 * every and kept < 0.5 * every


def test_without_a_filter_the_join_decides(spark, scratch, monkeypatch):
    star = os.path.join(scratch, "bloom-star")
    write_star(spark, star)
    rows = lambda: sorted(tuple(norm(v) for v in r) for r in usage.feature_adoption_pct(read_star(spark, star), Params()).collect())
    with_filter = rows()
    monkeypatch.setattr(usage.bloom, "build", lambda *a, **k: None)
    assert rows() == with_filter != []
