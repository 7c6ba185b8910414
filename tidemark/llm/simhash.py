"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint has segments of 23, 23 and 18 bits. Two fingerprints that
differ in at most two bits agree wholly in one segment (pigeonhole), and in the
next one by at most two bits. The perfect binary Golay code [23, 12, 7] turns
"at most two bits apart" into equality: every 23-bit word lies within three
bits of exactly one codeword, and decoding all words within one bit of a
segment gives one or six codeword indices. Segments up to two bits apart share
one, as the balls of radius one meet. A key is (which segment, its value, a
codeword index of the next): at most 18 keys a fingerprint, 30 or 35 bits
each. Fingerprints that share a key are joined and verified by their bits.

A key with many members (near copies of one text) is not joined with itself:
its members are linked through words one bit away, of which any two
fingerprints within two bits share one. That is exact and linear.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.components import connected_components

# Generator polynomial of the binary Golay code, and the segments (shift, bits).
GOLAY_GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))

MAX_DISTANCE = 2
SHINGLE_WORDS = 3


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Bit b is set if more than half the shingle hashes have it set."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    line = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[words - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    step = 1 << 16  # bounds the unpacked bits of a very long text
    for i in range(0, n, step):
        raw = np.array(hashes[i:i + step], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


@cache
def _golay() -> tuple[np.ndarray, list[np.ndarray]]:
    """Error pattern by syndrome, and the syndrome's parts by byte."""
    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GOLAY_GENERATOR << (bit - 11)
        return v

    single = [syndrome(1 << b) for b in range(23)]
    errors = np.zeros(2048, np.int64)
    for i in range(23):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    parts = [np.array([syndrome(v << s) if v << s < 1 << 23 else 0 for v in range(256)])
             for s in (0, 8, 16)]
    return errors, parts


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each 23-bit word."""
    errors, (low, mid, high) = _golay()
    syn = low[words & 255] ^ mid[words >> 8 & 255] ^ high[words >> 16]
    return (words ^ errors[syn]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the unsigned 64-bit fingerprints, each key once a row."""
    flips = np.array([0] + [1 << b for b in range(23)], np.int64)
    cut = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        near = np.sort(codeword_index(cut[(i + 1) % 3][:, None] ^ flips), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        at, _ = np.nonzero(new)
        rows.append(at)
        keys.append((i << 35) | (cut[i][at] << 12) | near[new])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS, with_key: bool = False) -> DataFrame:
    """(id, fp[, k1, k2]): the fingerprint as a signed long, and the text's key.
    A null or wordless text has fingerprint 0."""
    kept = ["id", "k1", "k2"] if with_key else ["id"]

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(fps.view(np.int64))], names=[*kept, "fp"])

    text = F.col(text_col)
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")] if with_key else []
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *keys)
    return slim.mapInArrow(run, ", ".join(f"{c} long" for c in [*kept, "fp"]))


def links(fps: DataFrame, joined_up_to: int = 32) -> DataFrame:
    """(a, b): links within MAX_DISTANCE bits that connect the distinct
    fingerprints ``fps`` (column ``fp``, stored) exactly as all such pairs do.
    Keys of more than ``joined_up_to`` members are linked through middle words."""
    def run(batches):
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            at, keys = golay_keys(own.view(np.uint64))
            yield pa.record_batch([pa.array(keys), pa.array(own[at])], names=["key", "fp"])

    keyed = fps.select("fp").mapInArrow(run, "key long, fp long")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keyed.join(shared, "key"), "golay")
    few = members.where(F.col("n") <= joined_up_to).select("key", "fp")
    pairs = (few.select("key", F.col("fp").alias("a"))
             .join(few.select("key", F.col("fp").alias("b")), "key")
             .where((F.col("a") > F.col("b"))
                    & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE))
             .select("a", "b"))
    # A middle word is a fingerprint or one bit from it; members of one are within two bits.
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)])
    middle = (members.where(F.col("n") > joined_up_to).select("fp").distinct()
              .select("fp", F.explode(F.transform(flips, lambda e: F.col("fp").bitwiseXOR(e))).alias("mid")))
    low = middle.groupBy("mid").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = middle.join(low, "mid").where(F.col("fp") > F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.union(star)


def _named(seen: DataFrame) -> DataFrame:
    """(fp, component) of stored (id, fp) rows."""
    each = stored(seen.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = connected_components(links(each))
    rooted = each.join(roots, each.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component"))
    return rooted.join(names, "root").select("fp", "root", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: id, fp (signed long) and component (the smallest
    id reachable over links of at most two differing bits, itself included).

    Nulls: a null text counts as wordless (fingerprint 0); a null id stays null
    and never names a component (a component of null ids has a null name).
    Repeated rows and ties share their fingerprint's component. Other columns of
    the input are ignored. An empty table gives an empty result.
    """
    seen = stored(fingerprints(docs, id_col, text_col, words), "simhash")
    return seen.join(_named(seen), "fp", "left").select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                words: int = SHINGLE_WORDS) -> DataFrame:
    """The input's rows, one of each component: the smallest id (null only if
    there is no other; ties by text key, and any one of rows that repeat id and
    text). Columns stay as they are, whatever their names."""
    seen = stored(fingerprints(docs, id_col, text_col, words, with_key=True), "simhash")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    kept = seen.join(_named(seen), "fp").groupBy("root").agg(F.min(place).alias("p")).select(
        F.coalesce("p.id", F.lit(0).cast("long")).alias("_i"), F.col("p.none").alias("_n"),
        F.col("p.k1").alias("_a"), F.col("p.k2").alias("_b"))
    kept = stored(kept, "kept")
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    own = docs.select(F.struct("*").alias("_doc"), F.coalesce(id_, F.lit(0).cast("long")).alias("_i"),
                      id_.isNull().alias("_n"), F.xxhash64(text).alias("_a"),
                      F.xxhash64(F.lit(7), text).alias("_b"))
    left = own.join(kept, ["_i", "_n", "_a", "_b"], "left_semi")
    twice = seen.groupBy("id", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        left = left.dropDuplicates(["_i", "_n", "_a", "_b"])
    return left.select("_doc.*")
