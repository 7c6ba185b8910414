"""Shards of near-equal size by best-fit-decreasing bin packing.

Rows of equal texts form a group that stays whole. Groups, largest first, go to
the bin with the least room that still holds them, found in a balanced tree of
remaining capacities. The packing has two levels so that no process sees all
groups: tasks pack their small groups into bundles of a fixed fraction of a
shard, and the bundles (a number bounded by shards and tasks, not by rows) are
packed into shards. The capacity is the least one that needs no more shards
than asked for. A group that exceeds a shard's share is cut into pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import positions, stored

BUNDLES = 64            # a bundle is this fraction of a shard's share
GROUPS_PER_TASK = 200_000


class Rooms:
    """Bins by remaining room: a treap, balanced by scrambled bin numbers."""

    def __init__(self):
        self.root = None

    def add(self, room: int, bin_: int) -> None:
        low, high = self._split(self.root, (room, bin_))
        node = [(room, bin_), (bin_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64), None, None]
        self.root = self._merge(self._merge(low, node), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (room, bin) with at least ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        path, node = [], high
        while node[2] is not None:
            path.append(node)
            node = node[2]
        if path:
            path[-1][2] = node[3]
        else:
            high = node[3]
        self.root = self._merge(low, high)
        return node[0]

    def _split(self, node, key):
        """Nodes below ``key`` and the others. A node is [key, priority, left, right]."""
        low = high = None
        low_end = high_end = None
        while node is not None:
            if node[0] < key:
                if low_end is None:
                    low = node
                else:
                    low_end[3] = node
                low_end, node = node, node[3]
            else:
                if high_end is None:
                    high = node
                else:
                    high_end[2] = node
                high_end, node = node, node[2]
        if low_end is not None:
            low_end[3] = None
        if high_end is not None:
            high_end[2] = None
        return low, high

    def _merge(self, a, b):
        top = end = None
        side = 0
        while a is not None and b is not None:
            if a[1] > b[1]:
                node, a, own = a, a[3], 3
            else:
                node, b, own = b, b[2], 2
            if end is None:
                top = node
            else:
                end[side] = node
            end, side = node, own
        rest = a if a is not None else b
        if end is None:
            return rest
        end[side] = rest
        return top


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each size, by best fit decreasing; a size over capacity gets a bin
    of its own. None if more than ``most`` bins are needed."""
    rooms, bins, out = Rooms(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = rooms.take(sizes[i])
        if got is None:
            if bins == most:
                return None
            got = (max(capacity, sizes[i]), bins)
            bins += 1
        out[i] = got[1]
        rooms.add(got[0] - sizes[i], got[1])
    return out


def into(sizes: list[int], shards: int) -> list[int]:
    """Bin of each size with the least capacity (found by halving) that needs at most ``shards``."""
    if not sizes:
        return []
    low = max(max(sizes), -(-sum(sizes) // shards))
    high, best = low, best_fit(sizes, low, shards)
    while best is None:
        low, high = high + 1, high + max(1, high // 50)
        best = best_fit(sizes, high, shards)
    while low < high:
        mid = (low + high) // 2
        got = best_fit(sizes, mid, shards)
        if got is None:
            low = mid + 1
        else:
            high, best = mid, got
    return best


def _bundled(pieces: DataFrame, limit: int, tasks: int) -> DataFrame:
    """Adds ``bundle`` (unique) to the pieces: each task packs the ones it has."""
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        order = np.lexsort([whole.column(c).to_numpy() for c in ("piece", "k2", "k1")])
        whole = whole.take(pa.array(order))
        bins = best_fit(whole.column("bytes").to_pylist(), limit)
        first = whole.column("task")[0].as_py() << 32
        yield from whole.drop(["task"]).append_column(
            "bundle", pa.array(np.array(bins, np.int64) + first)).to_batches(max_chunksize=50_000)

    dealt = pieces.repartition(tasks, "k1", "k2", "piece").withColumn("task", F.spark_partition_id().cast("long"))
    return dealt.mapInArrow(run, "k1 long, k2 long, piece long, bytes long, bundle long")


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
           row_bytes: int = 16) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes of the text plus
    ``row_bytes``), text_crc32, shard and slot (gapless from 0 in each shard, by
    id). Shards are near equal in bytes.

    Nulls: a null text has no bytes and checksum 0, and groups with null texts;
    null ids come first. Repeated rows are rows of their own in one group. A
    group of more than a shard's share of all bytes is cut into pieces of an
    eighth of it; nothing else splits groups. Other columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(row_bytes)).cast("long")
    rows = stored(docs.select(
        F.col(id_col).cast("long").alias("id"), size.alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")), "rows")
    groups = rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"), F.min("size").alias("one"))
    groups = stored(groups, "groups")
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    share = -(-total // shards)
    eighth = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(share // 8) / F.col("one")))
    # Rows of a piece, only for the fewer than ``shards`` groups over a share.
    big = groups.where(F.col("bytes") > share).select("k1", "k2", eighth.alias("per"))
    large = rows.join(F.broadcast(big), ["k1", "k2"])
    split = positions(large.withColumn("g", F.struct("k1", "k2")), ["id"], "large", group="g")
    split = split.withColumn("piece", F.floor(F.col("_before") / F.col("per"))).drop("_before", "g", "per")
    whole = rows.join(F.broadcast(big.select("k1", "k2")), ["k1", "k2"], "left_anti").withColumn(
        "piece", F.lit(0).cast("long"))
    rows = stored(whole.unionByName(split), "pieces")
    pieces = rows.groupBy("k1", "k2", "piece").agg(F.sum("size").alias("bytes"))
    tasks = max(1, -(-n // GROUPS_PER_TASK))
    bundled = stored(_bundled(pieces, max(1, share // BUNDLES), tasks), "bundles")
    # At most about 2 * BUNDLES per shard and one more per task.
    bundles = bundled.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy("bundle").collect()
    bins = into([b["bytes"] for b in bundles], shards)
    placed = spark.createDataFrame(
        [(b["bundle"], s) for b, s in zip(bundles, bins)], "bundle long, shard int")
    homes = bundled.join(F.broadcast(placed), "bundle").select("k1", "k2", "piece", "shard")
    out = rows.join(homes, ["k1", "k2", "piece"]).select("id", "size", "text_crc32", "shard")
    return positions(out, ["id", "text_crc32"], "slots", group="shard").withColumnRenamed("_before", "slot")
