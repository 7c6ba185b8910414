import bisect
import random
import zlib
from itertools import combinations

from llm import small
from tidemark.llm import packing, sharding


def test_rooms_is_a_sorted_set():
    rng, tree, want = random.Random(1), sharding.Rooms(), []
    for i in range(4000):
        if rng.random() < 0.6:
            key = (rng.randrange(500), i)
            tree.add(*key)
            bisect.insort(want, key)
        else:
            size = rng.randrange(500)
            at = bisect.bisect_left(want, (size, -1))
            assert tree.take(size) == (want.pop(at) if at < len(want) else None)


def test_best_fit_and_least_capacity():
    rng = random.Random(2)
    for _ in range(100):
        sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 40))]
        bins = sharding.best_fit(sizes, 60)
        for b in set(bins):
            assert sum(s for s, x in zip(sizes, bins) if x == b) <= 60
        own = sharding.into(sizes, 4)
        assert set(own) <= set(range(4)) and len(own) == len(sizes)
    assert sharding.best_fit([5, 7, 3], 10) == [1, 0, 0]
    assert sharding.into([], 3) == []


def test_shards(spark):
    values = small.texts()[:-1] * 3 + ["solo"] * 100
    got = sharding.assign(small.with_clashes(small.documents(spark, values)).withColumnRenamed("id", "x"), shards=5)
    rows = got.collect()
    assert sorted(r.id for r in rows) == list(range(len(values)))
    homes, load = {}, [0] * 5
    for r in rows:
        raw = (values[r.id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        homes.setdefault((values[r.id] is None, raw), set()).add(r.shard)
        load[r.shard] += r["size"]
    assert all(len(s) == 1 for s in homes.values())
    assert max(load) <= 1.02 * sum(load) / 5
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_a_group_over_a_share_is_cut(spark):
    values = ["c" * 100] * 600 + [f"t{i:04d}" * 5 for i in range(300)]
    rows = sharding.assign(small.documents(spark, values), shards=10).collect()
    load = [sum(r["size"] for r in rows if r.shard == s) for s in range(10)]
    assert max(load) <= 1.1 * sum(load) / 10 and len(rows) == 900
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(10) for i in range(sum(r.shard == s for r in rows))]


def test_shards_of_repeats_null_ids_and_empty(spark):
    df = small.repeated(small.documents(spark, ["a", None]))
    rows = sharding.assign(df, shards=2).collect()
    assert len(rows) == 6 and {r["size"] for r in rows} == {16, 17}
    assert sharding.assign(df.limit(0), shards=2).count() == 0


def padded(bounds, lengths, counts):
    return sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts))


def test_bounds_are_optimal():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randrange(1, 9)
        lengths, counts = sorted(rng.sample(range(1, 60), n)), [rng.randrange(1, 9) for _ in range(n)]
        k = rng.randrange(1, 5)
        best = min(padded([*c, lengths[-1]], lengths, counts) for m in range(k) for c in combinations(lengths, m))
        own = packing.best_bounds(lengths, counts, k)
        assert len(own) <= k and padded(own, lengths, counts) == best


def test_bins(spark):
    sizes = [0, 1, 2, 511, 512, 513, 514, 515, 1023, 1024, 1025, 1030, 4097, 10 ** 6, 2 ** 31]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    for r in df.select("n", packing.bin_of(df.n).alias("b")).collect():
        assert r.b >= max(1, r.n) and (r.b == max(1, r.n) if r.n <= 512 else r.b <= r.n * (1 + 1 / 256))


def test_batches(spark):
    values = small.texts() * 4
    got = packing.pack(small.with_clashes(small.documents(spark, values)).withColumnRenamed("id", "x"), buckets=4, budget=300)
    rows = got.collect()
    assert sorted(r.id for r in rows) == list(range(len(values)))
    counts = {i: len((t or "").split()) for i, t in enumerate(values)}
    batches: dict = {}
    for r in rows:
        assert r.n_tokens == counts[r.id] and r.padding == r.bucket_tokens - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for own in batches.values():
        assert len(own) * own[0].bucket_tokens <= 300 or len(own) == 1
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for b in {r.bucket for r in rows}:
        full = max(1, 300 // next(r.bucket_tokens for r in rows if r.bucket == b))
        sizes = [len(batches[k]) for k in sorted(batches) if k[0] == b]
        assert all(n == full for n in sizes[:-1])
        ids = [r.id for k in sorted(batches) if k[0] == b for r in sorted(batches[k], key=lambda r: r.slot)]
        assert ids == sorted(ids)
    lengths = sorted({max(1, n) for n in counts.values()})
    bins = {r.b: r.n for r in got.select(packing.bin_of(got.n_tokens).alias("b")).groupBy("b").count().toDF("b", "n").collect()}
    own = sorted(bins)
    assert {r.bucket_tokens for r in rows} <= set(own) and lengths
    assert padded({r.bucket_tokens for r in rows}, own, [bins[b] for b in own]) == \
        padded(packing.best_bounds(own, [bins[b] for b in own], 4), own, [bins[b] for b in own])


def test_packing_repeats_null_ids_and_empty(spark):
    df = small.repeated(small.documents(spark, ["a b", None]))
    assert packing.pack(df).count() == 6
    assert packing.pack(df.limit(0)).count() == 0


def test_bounds_of_long_lengths_are_optimal(spark):
    values = [" ".join(["w"] * n) for n in [1025] * 6 + [700, 701, 3, 2051, 2051]]
    rows = packing.pack(small.documents(spark, values), buckets=5).collect()
    assert {r.bucket_tokens for r in rows} == {3, 700, 701, 1025, 2051}
    assert sum(r.padding for r in rows) == 0


def least_padded(lengths, counts, k):
    """Every last cut of every prefix."""
    before = [0]
    for c in counts:
        before.append(before[-1] + c)
    cost = [b * c for b, c in zip(lengths, before[1:])]
    for _ in range(k - 1):
        cost = [min([cost[j]] + [cost[i] + lengths[j] * (before[j + 1] - before[i + 1]) for i in range(j)])
                for j in range(len(lengths))]
    return cost[-1]


def test_bounds_of_many_lengths_are_optimal():
    rng = random.Random(7)
    for scale in (1, 1, 1, 2 ** 50):
        for n in (17, 60, 250):
            lengths = sorted(rng.sample(range(1, 20_000), n))
            counts = [max(1, int(rng.paretovariate(0.8))) * scale for _ in lengths]
            for k in (1, 2, 3, 7, 16):
                own = packing.best_bounds(lengths, counts, k)
                assert len(own) <= k and padded(own, lengths, counts) == least_padded(lengths, counts, k)
