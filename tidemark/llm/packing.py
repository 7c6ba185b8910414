"""Length buckets with the least padding, and token-budget batches in them.

The bucket bounds are exact optima of a dynamic program over the global
histogram of the lengths as they are. Spark groups it; only the distinct lengths
and their counts reach the driver. As the best last cut never moves back when
the lengths go up, each bucket more is found by divide and conquer, all middles
of a depth at once. Inside a bucket, documents in id order fill batches of as
many rows as the token budget holds at the bucket's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import positions, stored

BUCKETS = 16
BUDGET = 8192


def token_count(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def bin_of(n: Column) -> Column:
    """The length's bin, the length itself; no tokens are padded to one."""
    return F.greatest(F.lit(1).cast("long"), n)


def _more(cost: np.ndarray, bound: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of the first j + 1 lengths with one bucket more, and the last
    length of the buckets before it (-1: one bucket fewer is as good)."""
    n = len(bound)
    best, at = cost.copy(), np.full(n, -1)
    # Stretches of j, each with the range of cuts its middle may have.
    first, stop, low, high = (np.array([x]) for x in (1, n, 0, n - 2))
    while len(first):
        j = (first + stop) // 2
        top = np.minimum(high, j - 1)
        sizes = top - low + 1
        begins = np.cumsum(sizes) - sizes
        i = np.arange(int(sizes.sum())) - np.repeat(begins - low, sizes)
        here = np.repeat(j, sizes)
        total = cost[i] + bound[here] * (before[here + 1] - before[i + 1])
        least = np.minimum.reduceat(total, begins)
        hit = np.nonzero(total == np.repeat(least, sizes))[0]
        cut = i[hit[np.searchsorted(hit, begins)]]
        better = least < best[j]
        best[j[better]], at[j[better]] = least[better], cut[better]
        first, stop, low, high = (np.concatenate(x) for x in (
            (first, j + 1), (j, stop), (low, cut), (cut, high)))
        some = first < stop
        first, stop, low, high = first[some], stop[some], low[some], high[some]
    return best, at


def best_bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets that minimise the padded
    total, the sum of each document's bucket bound. ``lengths`` ascend."""
    n = len(lengths)
    if n <= buckets:
        return list(lengths)
    # Exact in 64 bits, or else in Python's integers.
    kind = np.int64 if 2 * lengths[-1] * sum(counts) < 2 ** 63 else object
    bound = np.array(lengths, kind)
    before = np.concatenate([np.zeros(1, kind), np.cumsum(np.array(counts, kind))])
    cost = bound * before[1:]                      # one bucket for the first j + 1 lengths
    cuts = []
    for _ in range(buckets - 1):
        cost, at = _more(cost, bound, before)
        cuts.append(at)
    out, j = [], n - 1
    for at in reversed(cuts):
        if at[j] < 0:
            # Fewer buckets are as good; the first lengths share one.
            continue
        out.append(lengths[j])
        j = int(at[j])
    out.append(lengths[j])
    return sorted(set(out))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
         budget: int = BUDGET) -> DataFrame:
    """One row per input row: id, n_tokens, bucket, bucket_tokens (its bound),
    batch and slot (both from 0 in each bucket), padding.

    Nulls: a null or empty text has no tokens and is padded to its bucket like
    any other; null ids come first. Repeated rows are packed as often as they
    come, ties in id by length. A text longer than the budget is a batch of its
    own if its bucket's bound exceeds the budget. Other columns are ignored. An
    empty table gives an empty result.
    """
    counted = docs.select(F.col(id_col).cast("long").alias("id"), token_count(F.col(text_col)).alias("n_tokens"))
    # The texts are read once; histogram, range bounds and batches need the counts alone.
    counted = stored(counted, "lengths")
    counted = counted.withColumn("bin", bin_of(F.col("n_tokens")))
    histogram = counted.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    bounds = best_bounds([r["bin"] for r in histogram], [r["n"] for r in histogram], buckets)
    bucket = F.lit(0)
    tokens = F.lit(bounds[0] if bounds else 1)
    for i in range(1, len(bounds)):
        over = F.col("bin") > bounds[i - 1]
        bucket, tokens = F.when(over, i).otherwise(bucket), F.when(over, bounds[i]).otherwise(tokens)
    placed = counted.select("id", "n_tokens", bucket.cast("int").alias("bucket"),
                            tokens.cast("long").alias("bucket_tokens"))
    placed = positions(placed, ["id", "n_tokens"], "packing", group="bucket")
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    return placed.select(
        "id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("_before") / per).alias("batch"),
        F.pmod(F.col("_before"), per).alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))
