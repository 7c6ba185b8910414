import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm import small
from tidemark.llm import simhash


def plain(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", small.lower_ascii(text))
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_fingerprints():
    for t in small.texts():
        assert simhash.fingerprint(t) == plain(t)


def test_golay_code_is_perfect():
    every = np.arange(1 << 23)
    assert np.bincount(simhash.codeword_index(every)).tolist() == [2048] * 4096


def test_golay_keys_meet_within_two_bits():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(3)):
            b ^= 1 << bit
        at, keys = simhash.golay_keys(np.array([a, b], dtype=np.uint64))
        assert set(keys[at == 0].tolist()) & set(keys[at == 1].tolist())
        assert len(keys) <= 36


@pytest.mark.parametrize("joined_up_to", [32, 2])
def test_components_of_crowded_fingerprints(spark, joined_up_to):
    """A chain and a ball of near fingerprints, by pairs and by middle words."""
    rng = random.Random(3)
    fps, x = set(), rng.getrandbits(64)
    for _ in range(60):
        x ^= 1 << rng.randrange(64)
        fps.add(x)
    y = rng.getrandbits(64)
    fps |= {y ^ (1 << i) ^ (1 << j) for i in range(6) for j in range(6)} | {rng.getrandbits(64) for _ in range(50)}
    own = sorted(v - (1 << 64) if v >> 63 else v for v in fps)
    df = spark.createDataFrame([(v,) for v in own], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df, joined_up_to).collect()}
    mask = (1 << 64) - 1
    near = lambda i, j: ((own[i] ^ own[j]) & mask).bit_count() <= 2
    at = {v: i for i, v in enumerate(own)}
    pairs = {(at[a], at[b]) for a, b in got}
    assert all(near(i, j) for i, j in pairs)
    assert small.components(len(own), lambda i, j: (i, j) in pairs or (j, i) in pairs) == \
        small.components(len(own), near)


def test_near_duplicates(spark):
    values = small.texts()
    fps = [plain(t) for t in values]
    want = small.components(len(values), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    got = simhash.near_duplicates(small.with_clashes(small.documents(spark)).withColumnRenamed("id", "doc"))
    assert small.rows(got, "id", "component") == sorted(zip(range(len(values)), want))


def test_repeats_null_ids_and_empty(spark):
    df = small.repeated(small.documents(spark, ["a b c d", None, "zz"]))
    got = simhash.near_duplicates(df)
    assert got.count() == 9
    assert {r.component for r in got.collect()} == {0, 1, 2}
    only = df.where("doc_id IS NULL")
    assert {r.component for r in simhash.near_duplicates(only).collect()} == {None}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each(spark):
    df = small.with_clashes(small.repeated(small.documents(spark)))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    values = small.texts()
    fps = [plain(t) for t in values]
    want = set(small.components(len(values), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(want)
    nulls = simhash.one_of_each(df.where(F.col("doc_id").isNull()))
    assert nulls.count() == len(want)
