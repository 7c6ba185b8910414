"""Prefix trie of conversations, rebuilt on shared openings.

A node is a distinct sequence of first turns. Its digest is a sum: every turn
adds 128 bits that hash its place, role and text, so a conversation's prefix
digests are running sums, which Spark adds up in chunks of a conversation (no
conversation is one task's work). Distinct digests are the nodes; that no two
sequences share one is verified over all nodes by their parents' digests and
SHA-256 of their last turns, and another seed is taken if two do.

Sums over subtrees go through node tables. Every node belongs to the smallest
conversation that has it, and a conversation's nodes with all their ancestors
go to one shard. There a minimal perfect hash numbers the distinct digests
(verified against the digests stored at the slots), own values are scattered
into flat arrays, and each depth, the deepest first, adds its sums to its
parents' slots. A node's sums of all shards add up to its subtree's, since
each node's own value stands in one shard. Depths beyond BAND are taken band by
band from below, what a band's top collects going to its parent in the next.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import positions, stored

OPENING = 3            # shared opening turns at most (the rule takes crc32 mod 4)
FAMILY = 20            # conversations that share a base
CHUNK = 1024           # turns summed in one window
BAND = 16384           # depths of one round of accumulation
SHARD_ROWS = 100_000   # rows of a shard's table
ID_CHUNK = 8192        # conversation ids in one piece of a node's end list

_KEY = ["a", "b", "c", "d"]   # 32 bits each


# ----------------------------------------------------- minimal perfect hash

class Slots:
    """Minimal perfect hash of distinct keys (rows of four 32-bit numbers): each
    round hashes what is left into a bit array; keys alone in their bit keep it,
    and a key's slot is the rank of its bit."""

    GAMMA = 2

    def __init__(self, keys: np.ndarray):
        self.rounds: list[tuple[np.ndarray, int]] = []
        left, start = keys, 0
        while len(left):
            size = max(8, self.GAMMA * len(left))
            at = self._hash(left, len(self.rounds), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + start
            self.rounds.append((np.where(alone, rank, -1), size))
            start += int(alone.sum())
            left = left[~alone[at]]
        self.keys = np.zeros((len(keys), keys.shape[1]), keys.dtype)
        slots = self._find(keys)
        if len(np.unique(slots)) != len(keys):
            raise ValueError("slots are not distinct")
        self.keys[slots] = keys

    @staticmethod
    def _hash(keys: np.ndarray, turn: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.full(len(keys), 0x9E3779B97F4A7C15 * (2 * turn + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for c in range(keys.shape[1]):
                h ^= keys[:, c].astype(np.uint64)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
        return (h % np.uint64(size)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        for turn, (bits, size) in enumerate(self.rounds):
            open_ = np.nonzero(out < 0)[0]
            if not len(open_):
                break
            out[open_] = bits[self._hash(keys[open_], turn, size)]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 for keys that the table does not hold."""
        out = self._find(keys)
        found = np.nonzero(out >= 0)[0]
        wrong = (self.keys[out[found]] != keys[found]).any(1)
        out[found[wrong]] = -1
        return out


def accumulate(keys, parents, depth, values) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct key, its sums over subtrees); rows that repeat a
    key add their ``values`` (rows of integers) to it."""
    distinct, first = np.unique(keys, axis=0, return_index=True)
    table = Slots(distinct)
    n = len(distinct)
    slot = table.find(keys)
    total = np.zeros((n, values.shape[1]), np.int64)
    np.add.at(total, slot, values)
    row = np.zeros(n, np.int64)
    row[slot[first]] = first
    deep, parent = depth[row], table.find(parents[row])
    order = np.argsort(-deep, kind="stable")
    edges = np.nonzero(np.diff(deep[order]))[0] + 1
    for level in np.split(order, edges):
        level = level[parent[level] >= 0]
        np.add.at(total, parent[level], total[level])
    return row, total


# ------------------------------------------------------------------- turns

def n_words(text) -> F.Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after the rebuild. Turns: conv, depth (from 1),
    turn (SHA-256 of role and text), words. Conversations: conv, depth (0: turnless)."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("at"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn"),
        n_words(text).alias("words"))
    # Stored as digests: the order below passes over the rows twice.
    own = positions(stored(rows, "trie-digests"), ["at", "turn"], "trie-turns", group="conv").select(
        "conv", F.col("_before").alias("pos"), "turn", "words")
    own = stored(own, "trie-turns")
    # The first turns of each base, and for every conversation how many it takes.
    base = own.where((F.col("pos") < OPENING) & (F.col("conv") % FAMILY == 0)).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn", "words"))).alias("opening"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % (OPENING + 1)).cast("int")
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h)
    convs = convs.join(base.withColumnRenamed("conv", "base"), F.expr(f"conv - conv % {FAMILY} = base"), "left").select(
        "conv", "n", "h", F.slice(F.coalesce("opening", F.expr("array()")), F.lit(1), F.col("h")).alias("opening"))
    convs = stored(convs.withColumn("taken", F.size("opening").cast("long")), "trie-conversations")
    shared = convs.select("conv", F.explode("opening").alias("o")).select(
        "conv", (F.col("o.pos") + 1).alias("depth"), "o.turn", "o.words")
    kept = own.join(convs.select("conv", "h", "taken"), "conv").where("pos >= h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "turn", "words")
    ends = convs.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))
    return shared.unionByName(kept), ends


def with_prefixes(turns: DataFrame, seed: int, chunk: int = CHUNK) -> DataFrame:
    """``turns`` plus the digest of the prefix that ends there (a, b, c, d) and of
    the one before (pa .. pd); the root's digest is zero."""
    low = F.lit(0xFFFFFFFF).cast("long")
    x, y = F.xxhash64(F.lit(seed), "depth", "turn"), F.xxhash64("turn", "depth", F.lit(seed + 1))
    parts = [x.bitwiseAND(low), F.shiftrightunsigned(x, 32), y.bitwiseAND(low), F.shiftrightunsigned(y, 32)]
    rows = turns.withColumn("chunk", F.floor((F.col("depth") - 1) / chunk).cast("long")).withColumns(
        {f"t{k}": p for k, p in zip(_KEY, parts)})
    inside = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: F.sum(f"t{k}").over(inside) for k in _KEY})
    # What earlier chunks of a conversation add; most have only one chunk. Sums
    # of 32-bit numbers stay below 2^63 for 2^31 turns.
    over = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "chunk").agg(*[F.sum(f"t{k}").alias(f"s{k}") for k in _KEY])
    starts = totals.select("conv", "chunk", *[F.sum(f"s{k}").over(over).alias(f"s{k}") for k in _KEY]).where("chunk > 0")
    late = rows.where("chunk > 0").join(starts, ["conv", "chunk"])
    late = late.select("conv", "depth", "turn", "words", *[(F.col(k) + F.col(f"s{k}")).alias(k) for k in _KEY],
                       *[f"t{k}" for k in _KEY])
    early = rows.where("chunk = 0").select("conv", "depth", "turn", "words", *_KEY, *[f"t{k}" for k in _KEY])
    return early.unionByName(late).select(
        "conv", "depth", "turn", "words", *[F.col(k).bitwiseAND(low).alias(k) for k in _KEY],
        *[(F.col(k) - F.col(f"t{k}")).bitwiseAND(low).alias(f"p{k}") for k in _KEY])


# ------------------------------------------------------------------- nodes

_UP = [f"p{k}" for k in _KEY]
_NODE = ["depth", *_KEY]


def _nodes(prefixes: DataFrame, ends: DataFrame) -> DataFrame:
    """Distinct nodes with their members' count and smallest conversation, and how
    many parents and last turns their digest stands for (1 each if it is sound)."""
    found = prefixes.groupBy(*_NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        *[F.min(u).alias(u) for u in _UP],
        (F.min(F.struct(*_UP, "turn")) == F.max(F.struct(*_UP, "turn"))).alias("sound"))
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), *[zero.alias(k) for k in _KEY], "conv_id", "n_convs", zero.alias("words"),
        *[F.lit(None).cast("long").alias(u) for u in _UP], F.lit(True).alias("sound"))
    return found.unionByName(root)


def _shards(rows: DataFrame, shards: int) -> DataFrame:
    """Sums of each shard. ``rows``: conv, the node, its parent, leaves, saved."""
    names = [*_KEY, *_UP, "depth", "leaves", "saved"]
    out = [*_NODE, *_UP, "leaves", "saved"]

    def run(batches):
        key, held = None, []

        def sums():
            cols = {c: np.concatenate([h[c] for h in held]) for c in names}
            keys = np.stack([cols[c] for c in _KEY], 1).astype(np.int64)
            up = np.stack([cols[c] for c in _UP], 1).astype(np.int64)
            # The depth belongs to the key, so that a node is never its own ancestor.
            keys = np.hstack([keys, cols["depth"][:, None]])
            above = np.hstack([up, cols["depth"][:, None] - 1])
            row, total = accumulate(keys, above, cols["depth"], np.stack([cols["leaves"], cols["saved"]], 1))
            return pa.record_batch([*[pa.array(cols[c][row]) for c in [*_NODE, *_UP]], pa.array(total[:, 0]),
                                    pa.array(total[:, 1])], names=out)

        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column("shard").to_numpy()
            edges = np.nonzero(np.diff(shard))[0] + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
                if shard[i] != key:
                    if held:
                        yield sums()
                    key, held = shard[i], []
                part = b.slice(i, j - i)
                held.append({c: part.column(c).to_numpy(zero_copy_only=False) for c in names})
        if held:
            yield sums()

    # Families share their openings, so a family goes to one shard.
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.floor(F.col("conv") / FAMILY)), F.lit(shards)))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard").select("shard", *names)
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in out))


def _subtree_sums(nodes: DataFrame, prefixes: DataFrame, band: int, shard_rows: int) -> DataFrame:
    """Leaves and saved tokens of each node's subtree. ``nodes``: with their own
    ``leaves`` and ``saved``."""
    zero = F.lit(0).cast("long")
    owners = nodes.where("depth > 0").groupBy(F.col("conv_id").alias("conv")).agg(F.min("depth").alias("first"))
    above = prefixes.select("conv", *_NODE, *_UP).join(owners, "conv").where("depth < first").select(
        "conv", *_NODE, *_UP, zero.alias("leaves"), zero.alias("saved"))
    own = nodes.where("depth > 0").select(F.col("conv_id").alias("conv"), *_NODE, *_UP, "leaves", "saved")
    rows = stored(own.unionByName(above).withColumn("band", F.floor((F.col("depth") - 1) / band).cast("long")), "trie-rows")
    counts = {r[0]: r[1] for r in rows.groupBy("band").agg(F.count(F.lit(1))).collect()}
    done, carried = [], None
    for k in sorted(counts, reverse=True):
        here = rows.where(F.col("band") == k).drop("band")
        n = counts[k]
        if carried is not None:
            carried = stored(carried, "trie-carried")
            here, n = here.unionByName(carried), n + carried.count()
        sums = _shards(here, max(1, -(-n // shard_rows)))
        sums = stored(sums.groupBy(*_NODE).agg(
            *[F.min(u).alias(u) for u in _UP], F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-sums")
        done.append(sums)
        # The band's top nodes add to their parents, in a band that then is last or next.
        top = sums.where(F.col("depth") == k * band + 1)
        up = top.groupBy(*_UP).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(
            F.lit(k * band).cast("long").alias("depth"), *[F.col(u).alias(x) for u, x in zip(_UP, _KEY)], "leaves", "saved")
        if k:
            carried = up.alias("u").join(nodes.alias("n"), F.expr(" AND ".join(f"u.{c} = n.{c}" for c in _NODE))).select(
                F.col("n.conv_id").alias("conv"), *[f"n.{c}" for c in [*_NODE, *_UP]], "u.leaves", "u.saved")
            # With its ancestors in the band, which the owner's turns give.
            chain = carried.select("conv", F.col("depth").alias("_to")).distinct()
            more = prefixes.select("conv", *_NODE, *_UP).join(chain, "conv").where(
                (F.col("depth") < F.col("_to")) & (F.col("depth") > (k - 1) * band)).select(
                "conv", *_NODE, *_UP, zero.alias("leaves"), zero.alias("saved"))
            carried = carried.unionByName(more)
        else:
            done.append(up.select("depth", *_KEY, *[F.lit(None).cast("long").alias(u) for u in _UP], "leaves", "saved"))
    if not done:
        return nodes.limit(0).select(*_NODE, "leaves", "saved")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*_NODE, "leaves", "saved")


def _end_lists(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end. ``ends``: conv and
    its node. Ids are sorted over all tasks and joined in pieces, so that only a
    node's pieces, not its rows, come together to be hashed one after the other."""
    def pieces(batches):
        key, ids, out = None, [], []

        def done():
            out.append((*key, ids[0], ",".join(map(str, ids))))

        def flush():
            cols = list(zip(*out))
            batch = pa.record_batch([*[pa.array(c, pa.int64()) for c in cols[:-1]], pa.array(cols[-1], pa.string())],
                                    names=[*_NODE, "first", "ids"])
            out.clear()
            return batch

        for b in batches:
            for *node, conv in zip(*[b.column(c).to_pylist() for c in [*_NODE, "conv"]]):
                if tuple(node) != key or len(ids) >= ID_CHUNK:
                    if ids:
                        done()
                    key, ids = tuple(node), []
                ids.append(conv)
            if len(out) >= 512:
                yield flush()
        if ids:
            done()
        if out:
            yield flush()

    def hashed(batches):
        key, h, out = None, None, []
        names, types = [*_NODE, "ends_sha256"], [pa.int64()] * 5 + [pa.string()]
        for b in batches:
            for *node, ids in zip(*[b.column(c).to_pylist() for c in [*_NODE, "ids"]]):
                if tuple(node) != key:
                    if h:
                        out.append((*key, h.hexdigest()))
                    key, h = tuple(node), sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if len(out) > 20_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if h:
            out.append((*key, h.hexdigest()))
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    fields = ", ".join(f"{c} long" for c in _NODE)
    ordered = ends.repartitionByRange(*_NODE, "conv").sortWithinPartitions(*_NODE, "conv")
    joined = ordered.mapInArrow(pieces, f"{fields}, first long, ids string")
    return joined.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(hashed, f"{fields}, ends_sha256 string")


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
         text_col: str = "text", band: int = BAND, shard_rows: int = SHARD_ROWS, chunk: int = CHUNK) -> DataFrame:
    """One row a node of the rebuilt conversations' trie: conv_id (smallest
    member), depth, parent_conv_id (the root's is null), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn_col``, null first, turns of one number by the
    SHA-256 of role and text, so turns that repeat wholly stay as turns of
    their own in a place that makes no difference. Null roles and texts are
    empty. Rows without conversation id belong to no conversation and are left
    out. Other columns are ignored. An empty table has no node, not even a root.
    """
    turns, ends = rebuilt(conversations, conv_col, turn_col, role_col, text_col)
    ends = stored(ends, "trie-ends")
    seed = 42
    while True:
        prefixes = stored(with_prefixes(turns, seed, chunk), "trie-prefixes")
        nodes = stored(_nodes(prefixes, ends), "trie-nodes")
        if nodes.where("NOT sound").limit(1).count() == 0:
            break
        seed += 2
    long = lambda c: F.lit(c).cast("long")
    none = F.lit(None).cast("long")

    # Children of each node; a parent's depth is one less.
    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *_UP).agg(
        F.count(F.lit(1)).alias("n_children")).select("depth", *[F.col(u).alias(k) for u, k in zip(_UP, _KEY)], "n_children")
    nodes = nodes.drop("sound").join(up, _NODE, "left").withColumn("n_children", F.coalesce("n_children", long(0)))
    nodes = stored(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("words")), "trie-nodes")
    sums = _subtree_sums(nodes, prefixes, band, shard_rows)

    last = ends.where("depth > 0").join(prefixes.select("conv", *_NODE), ["conv", "depth"]).select(*_NODE, "conv")
    last = last.unionByName(ends.where("depth = 0").select("depth", *[long(0).alias(k) for k in _KEY], "conv"))
    lists = _end_lists(last)

    # One exchange brings a node's parts together.
    parts = (nodes.select(*_NODE, *_UP, "conv_id", "n_convs", "n_children", "leaves", none.alias("below"),
                          none.alias("saved"), F.lit(None).cast("string").alias("ends"))
             .unionByName(sums.select(*_NODE, *[none.alias(c) for c in [*_UP, "conv_id", "n_convs", "n_children", "leaves"]],
                                      F.col("leaves").alias("below"), "saved", F.lit(None).cast("string").alias("ends")))
             .unionByName(lists.select(*_NODE, *[none.alias(c) for c in [*_UP, "conv_id", "n_convs", "n_children", "leaves",
                                                                          "below", "saved"]], F.col("ends_sha256").alias("ends"))))
    whole = parts.groupBy(*_NODE).agg(
        *[F.max(c).alias(c) for c in [*_UP, "conv_id", "n_convs", "n_children", "leaves"]],
        F.sum("below").alias("below"), F.sum("saved").alias("saved"), F.max("ends").alias("ends"))
    parent = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(u) for k, u in zip(_KEY, _UP)],
                          F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parent, ["depth", *_UP], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        # The root's own row stands outside the bands: a lone root is a leaf.
        F.when((F.col("depth") == 0) & (F.col("n_children") == 0), long(1)).otherwise(F.col("below")).alias("n_leaves"),
        F.coalesce("saved", long(0)).alias("saved_tokens"),
        F.coalesce("ends", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"))
