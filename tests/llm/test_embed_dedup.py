import numpy as np
import pytest

from llm import small
from tidemark.llm import embed_dedup


def plain(vectors, labels, cosine=embed_dedup.COSINE):
    unit = [None if v is None or not len(v) or not np.isfinite(v).all() or not np.any(v)
            else np.array(v) / np.abs(v).max() for v in vectors]
    unit = [v if v is None else v / np.linalg.norm(v) for v in unit]

    def linked(i, j):
        a, b = unit[i], unit[j]
        return (a is not None and b is not None and labels[i] is not None and labels[i] == labels[j]
                and len(a) == len(b) and bool(a @ b >= cosine))

    n = len(vectors)
    links = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
    root = small.components(n, linked)
    return [(i, links[i], root[i], root[i] == i) for i in range(n)]


def frame(spark, vectors, labels):
    rows = [(i, None if v is None else [float(x) for x in v], y, "n") for i, (v, y) in enumerate(zip(vectors, labels))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")


@pytest.mark.parametrize("size,n,chunk", [(64, 300, 2048), (8, 250, 16), (3, 200, 16), (1, 12, 2048)])
def test_against_brute_force(spark, monkeypatch, size, n, chunk):
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(size)
    centres = rng.standard_normal((max(1, n // 8), size))
    vectors = [(centres[rng.integers(len(centres))] + rng.standard_normal(size) * 0.16 * rng.random()) for _ in range(n)]
    labels = [int(x) for x in rng.integers(0, 2, n)]
    vectors += [vectors[0], vectors[0], None, np.zeros(size), np.full(size, np.nan), vectors[1], np.ones(size + 1),
                [], np.full(size, np.inf), vectors[2] * 1e200]
    labels += [labels[0], labels[0], 1, 1, 1, None, 1, 1, 1, labels[2]]
    got = embed_dedup.near_duplicates(frame(spark, vectors, labels))
    assert small.rows(got, "id", "n_links", "component", "kept") == plain(vectors, labels)


def test_forest_connects_like_its_links():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 80, 60), rng.integers(0, 80, 60)
    low, root = embed_dedup.forest(a, b)
    assert len(set(low.tolist())) == len(low)
    links = set(zip(a.tolist(), b.tolist()))
    tree = set(zip(low.tolist(), root.tolist()))
    assert small.components(80, lambda i, j: (i, j) in links or (j, i) in links) == \
        small.components(80, lambda i, j: (i, j) in tree or (j, i) in tree)


def test_repeats_null_ids_and_empty(spark):
    df = frame(spark, [[1.0, 0.0], [0.0, 1.0]], [1, 1])
    df = df.union(df).union(df.selectExpr("CAST(NULL AS BIGINT)", "embedding", "label", "node"))
    got = small.rows(embed_dedup.near_duplicates(df), "id", "n_links", "component", "kept")
    assert got == [(0, 2, 0, True), (0, 2, 0, True), (1, 2, 1, True), (1, 2, 1, True),
                   (None, 2, 0, False), (None, 2, 1, False)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def same_hash(label, vector, first):
    """A second part for which [first, part] has the 64-bit hash of ``vector`` (XXH64 of label and parts in turn)."""
    p1, p2, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    p3, mask = 0x165667B19E3779F9, 2 ** 64 - 1

    def turn(x, r):
        return (x << r | x >> (64 - r)) & mask

    def mixed(bits, seed):
        h = (seed + p5 + 8 & mask) ^ turn(bits * p2 & mask, 31) * p1 & mask
        h = turn(h, 27) * p1 + p4 & mask
        h = (h ^ h >> 33) * p2 & mask
        h = (h ^ h >> 29) * p3 & mask
        return h ^ h >> 32

    def bits_of(x):
        return int(np.float64(x).view(np.uint64))

    start = mixed(label, 42)
    seed = mixed(bits_of(vector[0]), start)
    goal = (seed + p5 + 8 & mask) ^ turn(bits_of(vector[1]) * p2 & mask, 31) * p1 & mask
    mine = mixed(bits_of(first), start)
    word = (goal ^ (mine + p5 + 8 & mask)) * pow(p1, -1, 2 ** 64) & mask
    return float(np.uint64(turn(word, 33) * pow(p2, -1, 2 ** 64) & mask).view(np.float64))


def test_vectors_of_one_64_bit_hash_stay_apart(spark):
    from pyspark.sql import functions as F

    own = [1.0, 0.5]
    other = next(v for i in range(1, 100_000) if (v := [i / 7, same_hash(1, own, i / 7)])[1] < -i / 700 and v[1] > -1e3 * i)
    df = frame(spark, [own, other], [1, 1])
    hashes = {r[0] for r in df.select(F.xxhash64(F.col("label").cast("long"), "embedding")).collect()}
    assert len(hashes) == 1
    got = small.rows(embed_dedup.near_duplicates(df), "id", "n_links", "component", "kept")
    assert got == [(0, 0, 0, True), (1, 0, 1, True)] == plain([own, other], [1, 1])
