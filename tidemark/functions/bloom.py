"""A Bloom filter over key columns, in plain Spark functions.

Spark's own runtime filters take one join key at a time and only small creation
sides. ``build`` sets HASHES bits a key in an array of 64-bit words, aggregated
by word, and keeps the words as one array. ``may_hold`` is true for every key
of the filter and for few others; used in a scan's filter it drops rows before
the first shuffle, and the join above still decides exactly.

The array goes to the tasks with the plan, so its size is bounded: BITS_PER_KEY
bits a key up to MOST_BITS. With more keys than that allows there is no filter
(``build`` returns None) and the join does all the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12          # about 1 key of 200 passes unasked for
HASHES = 4
MOST_BITS = 1 << 28        # 32 MB


def _bits(size: int, keys) -> list[Column]:
    """Bit numbers of a key: h1 + i * h2, as double hashing has them."""
    low, mask = F.lit(0x7FFFFFFF).cast("long"), F.lit(size - 1).cast("long")
    h = F.xxhash64(*keys)
    first, step = h.bitwiseAND(low), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long")).bitwiseAND(low)
    return [(first + F.lit(i).cast("long") * step).bitwiseAND(mask) for i in range(HASHES)]


class Bloom:
    """``words``: a one-row frame with the array ``w`` of 64-bit words."""

    def __init__(self, words: DataFrame, size: int, n: int):
        self.words, self.size, self.n = words, size, n

    def may_hold(self, *keys: str) -> Column:
        """Whether the key may be in the filter. A NULL among the columns is hashed
        as no value, so it may pass: the join drops it."""
        array = self.words.scalar()
        tests = [F.getbit(F.get(array, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
                 for b in _bits(self.size, keys)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def build(df: DataFrame, keys: list[str], most_bits: int = MOST_BITS) -> Bloom | None:
    """The filter of the distinct rows of ``df`` (counted first), or None if they
    are too many for ``most_bits``."""
    n = df.count()
    size = 64
    while size < n * BITS_PER_KEY:
        size *= 2
    if size > most_bits:
        return None
    one = F.lit(1).cast("long")
    bit = F.explode(F.array(*_bits(size, keys)))
    words = df.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", one, F.col("b").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("w"))
    spark = df.sparkSession
    every = spark.range(size // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("w"))
    whole = words.union(every).groupBy("at").agg(F.bit_or("w").alias("w"))
    array = whole.agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("a")).select(F.col("a.w").alias("w"))
    # The words are resolved once, as anchors are: later plans hold them as data.
    return Bloom(spark.createDataFrame(array.toArrow(), "w array<bigint>"), size, n)
