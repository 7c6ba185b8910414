import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import small
from tidemark.llm import block_knn


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain(rows, k=20, step=20):
    one = {}
    for i, v in rows:
        if i is not None and usable(v):
            one[i] = min(one.get(i, tuple(v)), tuple(v))
    fine, asked, out = sorted(one.items()), {}, []
    for i, v in fine:
        if i % step == 0:
            asked.setdefault(i, v)
    for q, v in asked.items():
        found = set()
        for i, w in fine:
            if i != q and len(w) == len(v):
                total = 0.0
                for a, b in zip(v, w):
                    total += a * b
                found.add((-total, i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "n") for i, v in rows],
                                 "vec_id long, embedding array<double>, node string")


def got(df, **more):
    found = block_knn.nearest(df, F.col("vec_id") % 20 == 0, **more)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("size,n,blocks", [(64, 500, {}), (8, 300, {"query_block": 4, "candidate_block": 64}),
                                           (1, 60, {}), (1100, 130, {"candidate_block": 40})])
def test_against_brute_force(spark, size, n, blocks):
    rng = np.random.default_rng(size)
    rows = [(i, rng.standard_normal(size) * 10.0 ** rng.integers(-2, 3)) for i in range(n)]
    rows += [(n + i, rows[i % 7][1]) for i in range(50)]          # equal vectors: ties go to the smaller id
    assert got(frame(spark, rows), **blocks) == plain(rows)


def test_unusable_vectors_and_other_sizes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(4)) for i in range(45)]
    rows += [(100, None), (120, []), (140, [0.0] * 4), (160, [1.0, None, 0.0, 2.0]), (180, [np.nan] * 4), (200, [np.inf, 1, 1, 1]),
             (220, [1.0, 2.0]), (221, [2.0, 2.0]), (240, [1.0]), (None, [9.0] * 4), (300, [-0.0, 0.0, 0.0, 1.0])]
    assert got(frame(spark, rows)) == plain(rows)


def test_one_very_common_vector(spark):
    rng = np.random.default_rng(2)
    common = rng.standard_normal(8)
    rows = [(i, common if i % 3 else rng.standard_normal(8)) for i in range(600)]
    assert got(frame(spark, rows), query_block=8, candidate_block=32) == plain(rows)


def test_repeated_rows_repeated_ids_and_empty(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(3)) for i in range(25)]
    rows += rows + [(20, rng.standard_normal(3)), (7, rng.standard_normal(3))]
    df = frame(spark, rows)
    assert got(df) == plain(rows)
    assert got(small.with_clashes(df.drop("node")).withColumn("query", F.lit("x"))) == plain(rows)
    assert got(df.limit(0)) == []
    assert got(frame(spark, [(20, [1.0])])) == []


@pytest.mark.parametrize("scale", [1e-200, 1e-30, 1.0, 1e30, 1e140])
def test_extreme_lengths_of_vectors(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5) * (scale if i % 2 else 1.0)) for i in range(120)]
    assert got(frame(spark, rows)) == plain(rows)


def test_bounds_hold_and_prune():
    """No pair above the k-th best is lost, and most pairs are not recomputed."""
    rng = np.random.default_rng(5)
    queries, candidates = rng.standard_normal((50, 64)), rng.standard_normal((6000, 64))
    seen = []
    original = block_knn.inner
    try:
        block_knn.inner = lambda a, b: seen.append(len(a)) or original(a, b)
        heaps = block_knn.Heaps(queries, 21)
        for i in range(0, 6000, 2000):
            heaps.offer(candidates[i:i + 2000], np.arange(i, i + 2000))
    finally:
        block_knn.inner = original
    exact = np.stack([original(np.repeat(q[None], 6000, 0), candidates) for q in queries])
    order = np.argsort(-exact, axis=1, kind="stable")[:, :21]
    assert (heaps.node == order).all()
    assert (heaps.score == np.take_along_axis(exact, order, 1)).all()
    assert sum(seen) < 0.05 * 50 * 6000
