"""Merkle manifest of a data set: one tree a source, one tree over the sources.

Nodes are SHA-256 digests. A run of ARITY neighbours hashes into its parent
until one node is left. A tree is cut into aligned blocks of HEIGHT levels,
each the work of one task; the roots of a level's blocks are the leaves of the
next level's, so a source with a third of all rows is only more blocks.

A block is one array in van Emde Boas order: its tree is split at half height
into a top tree and, from left to right, the bottom trees under it, each laid
out the same way, so a path from leaf to root touches few stretches of memory
whatever their size. ``address`` finds a node by arithmetic; construction and
the lookup of siblings both go through it. The paths of the upper levels are
handed down from block roots to the blocks under them.
"""

from __future__ import annotations

from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import positions, stored

ARITY = 3
HEIGHT = 6           # levels of a block: up to 3^6 = 729 leaves
DIGEST = 32          # bytes
_TOP = "top"         # the tree over the sources' roots


# ------------------------------------------------------------------ layout

def slots(height: int) -> int:
    """Nodes of a full tree of so many levels above its leaves."""
    return (ARITY ** (height + 1) - 1) // (ARITY - 1)


def address(height: int, depth: int, index: int) -> int:
    """Place of the node ``index`` of level ``depth`` (the root's is 0) in the
    van Emde Boas order of a full tree with ``height`` levels below its root."""
    at = 0
    while height:
        top = (height - 1) // 2            # the top tree has the levels 0 .. top
        if depth <= top:
            height = top
            continue
        below = height - top - 1
        under = ARITY ** (depth - top - 1)
        at += slots(top) + (index // under) * slots(below)
        height, depth, index = below, depth - top - 1, index % under
    return at


@cache
def addresses(height: int) -> list[list[int]]:
    """``address`` of every node: a list for each level, from the leaves up."""
    return [[address(height, d, i) for i in range(ARITY ** d)] for d in range(height, -1, -1)]


def join(digests) -> bytes:
    """H of digests as hex text."""
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


class Block:
    """An aligned subtree in van Emde Boas order; absent nodes hold zeros."""

    def __init__(self, height: int, leaves: int, nodes: bytes | bytearray):
        self.height, self.leaves, self.nodes = height, leaves, nodes

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> "Block":
        block = cls(height, len(leaves), bytearray(slots(height) * DIGEST))
        where, row = addresses(height), leaves
        for level in range(height + 1):
            for i, d in enumerate(row):
                at = where[level][i] * DIGEST
                block.nodes[at:at + DIGEST] = d
            if level < height:
                row = [join(row[i:i + ARITY]) for i in range(0, len(row), ARITY)]
        return block

    def node(self, level: int, index: int) -> bytes:
        """Level 0 holds the leaves."""
        at = addresses(self.height)[level][index] * DIGEST
        return bytes(self.nodes[at:at + DIGEST])

    @property
    def root(self) -> bytes:
        return self.node(self.height, 0)

    def path(self, leaf: int) -> bytes:
        """Siblings of the leaf and of its ancestors below the block's root:
        for each level how many stand left, how many right, then their digests."""
        out, n = bytearray(), self.leaves
        for level in range(self.height):
            first = leaf - leaf % ARITY
            last = min(n, first + ARITY)
            out += bytes([leaf - first, last - leaf - 1])
            for i in range(first, last):
                if i != leaf:
                    out += self.node(level, i)
            leaf, n = leaf // ARITY, -(-n // ARITY)
        return bytes(out)


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path's siblings give."""
    at = 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        at += 2
        ds = [path[at + i * DIGEST:at + (i + 1) * DIGEST] for i in range(left + right)]
        at += (left + right) * DIGEST
        leaf = join([*ds[:left], leaf, *ds[left:]])
    return leaf


def proof(path: bytes) -> bytes:
    """The siblings of a path alone, as hex text, in its order."""
    out, at = [], 0
    while at < len(path):
        n = path[at] + path[at + 1]
        out.append(path[at + 2:at + 2 + n * DIGEST].hex().encode())
        at += 2 + n * DIGEST
    return b"".join(out)


def levels_of(n: int) -> int:
    """Levels above n leaves until one node remains."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


# ------------------------------------------------------------ construction

_BLOCK = "tree string, named boolean, block long, n long, height int, root binary, nodes binary, extra binary"


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """A row for each block. ``leaves``: tree, named (false: the null tree), pos
    (gapless from 0 in each tree), total (leaves of the tree), digest, extra
    (bytes that go with the leaf, all of one length in a tree)."""
    span = ARITY ** height

    def run(batches):
        key, total, digests, extras = None, 0, [], []

        def done():
            tall = min(height, levels_of(total))
            b = Block.build(digests, tall)
            return (key[0], key[1], key[2], len(digests), tall, b.root, bytes(b.nodes), b"".join(extras))

        def batch(rows):
            schema = pa.schema([("tree", pa.string()), ("named", pa.bool_()), ("block", pa.int64()), ("n", pa.int64()),
                                ("height", pa.int32()), ("root", pa.binary()), ("nodes", pa.binary()), ("extra", pa.binary())])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        out = []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("tree", "named", "block", "total", "digest", "extra")]
            for tree, named, block, n, digest, extra in zip(*cols):
                if (tree, named, block) != key:
                    if digests:
                        out.append(done())
                    key, total, digests, extras = (tree, named, block), n, [], []
                digests.append(digest)
                extras.append(extra)
                if len(out) >= 64:
                    yield batch(out)
                    out = []
        if digests:
            out.append(done())
        if out:
            yield batch(out)

    dealt = leaves.withColumn("block", F.floor(F.col("pos") / span).cast("long"))
    dealt = dealt.repartition("tree", "named", "block").sortWithinPartitions("tree", "named", "block", "pos")
    return dealt.select("tree", "named", "block", "total", "digest", "extra").mapInArrow(run, _BLOCK)


def _tree(leaves: DataFrame, height: int, what: str) -> list[DataFrame]:
    """Block tables from the leaves up; the last one has one block a tree."""
    tables = []
    while True:
        tables.append(stored(_blocks(leaves, height), what))
        if tables[-1].where("block > 0").limit(1).count() == 0:
            return tables
        # A tree of one block is finished: its blocks are left out above.
        below = tables[-1]
        sizes = below.groupBy("tree", "named").agg(F.count(F.lit(1)).alias("total")).where("total > 1")
        leaves = below.alias("b").join(
            sizes.alias("s"), F.expr("b.tree <=> s.tree AND b.named = s.named")).select(
            "b.tree", "b.named", F.col("b.block").alias("pos"), "s.total", F.col("b.root").alias("digest"),
            F.lit(b"").alias("extra"))


_PATH = "tree string, named boolean, block long, top binary, path binary"


def _handed_down(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of the leaves of ``blocks``, that is of the blocks one table below.
    ``paths``: the path of each block's root to the very top, and the tree's root."""
    def run(batches):
        schema = pa.schema([("tree", pa.string()), ("named", pa.bool_()), ("block", pa.int64()),
                            ("top", pa.binary()), ("path", pa.binary())])
        for b in batches:
            names = ("tree", "named", "block", "n", "height", "nodes", "top", "path")
            for tree, named, block, n, tall, nodes, top, path in zip(*[b.column(c).to_pylist() for c in names]):
                own = Block(tall, n, nodes)
                first = block * ARITY ** tall
                rows = [(tree, named, first + i, top, own.path(i) + path) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return _with_paths(blocks, paths).mapInArrow(run, _PATH)


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    return blocks.alias("b").join(paths.alias("p"), F.expr(
        "b.tree <=> p.tree AND b.named = p.named AND b.block = p.block")).select("b.*", "p.top", "p.path")


def field(value) -> F.Column:
    """`-` for null, else UTF-8 byte count, `:` and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(id_col, source, lang, n_chars, text) -> F.Column:
    """Digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in (id_col, source, lang, n_chars, text)]), 256))


def manifest(docs: DataFrame, presented: F.Column | None = None, id_col: str = "doc_id", source_col: str = "source",
             lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof (siblings' digests as
    one hex text, hashed: proof_sha256), folded_root and verified.

    ``presented`` is the text that a holder shows (default: the text itself);
    folded_root is what its leaf and the original siblings give, and verified
    says whether that is the root.

    A source's leaves ascend by id, null ids first; rows of one id by their
    leaf, so repeated rows, whose leaves are equal, may change places without
    any effect on a digest. Null source, language, count and text are `-` in the leaf; the
    null source is a tree of its own, apart from the empty one. An empty table
    gives an empty result. Other columns are ignored.
    """
    cols = {"id": F.col(id_col), "source": F.col(source_col)}
    rest = [F.col(lang_col), F.col(chars_col), F.col(text_col)]
    shown = presented if presented is not None else F.col(text_col)
    rows = docs.select(
        cols["id"].cast("long").alias("id"), cols["source"].alias("tree"), cols["source"].isNotNull().alias("named"),
        leaf_digest(cols["id"], cols["source"], *rest).alias("digest"),
        F.when(~shown.eqNullSafe(F.col(text_col)),
               leaf_digest(cols["id"], cols["source"], rest[0], rest[1], shown)).alias("other"))
    placed = positions(rows, ["id", "digest"], "merkle-leaves", group="tree")
    sizes = placed.groupBy("tree").agg(F.max("_before").alias("last"))
    # Whether there is an id, the id and the presented leaf, at fixed places.
    extra = F.concat(F.when(F.col("id").isNull(), F.lit(b"\x00")).otherwise(F.lit(b"\x01")),
                     F.unhex(F.lpad(F.hex(F.coalesce("id", F.lit(0).cast("long"))), 16, "0")),
                     F.coalesce("other", "digest"))
    leaves = placed.alias("l").join(sizes.alias("s"), F.expr("l.tree <=> s.tree")).select(
        "l.tree", "l.named", F.col("_before").alias("pos"), (F.col("s.last") + 1).alias("total"), "digest",
        extra.alias("extra"))
    own = _tree(leaves, height, "merkle-source")

    # The sources' roots in order: null first, then by bytes.
    roots = None
    for k, t in enumerate(own):
        final = t.where("block = 0") if k == len(own) - 1 else t.alias("t").join(
            t.where("block > 0").select("tree", "named").distinct().alias("m"),
            F.expr("t.tree <=> m.tree AND t.named = m.named"), "left_anti")
        final = final.select("tree", "named", F.lit(k).alias("at"), "root")
        roots = final if roots is None else roots.union(final)
    roots = stored(positions(roots, ["named", "tree"], "merkle-roots"), "merkle-roots")
    n = roots.count()
    over = _tree(roots.select(F.lit(_TOP).alias("tree"), F.lit(True).alias("named"), F.col("_before").alias("pos"),
                              F.lit(n).cast("long").alias("total"), F.col("root").alias("digest"),
                              F.lit(b"").alias("extra")), height, "merkle-top")

    # Down again: the top block's root has no path.
    paths = over[-1].select("tree", "named", "block", F.col("root").alias("top"), F.lit(b"").alias("path"))
    for blocks in reversed(over):
        paths = stored(_handed_down(blocks, paths), "merkle-paths")
    subs = roots.alias("r").join(paths.alias("p"), F.expr("r._before = p.block")).select(
        "r.tree", "r.named", "r.at", F.col("r.root").alias("subroot"), "p.top", "p.path")

    down, parts = None, []
    for k in range(len(own) - 1, -1, -1):
        begin = subs.where(F.col("at") == k).select(
            "tree", "named", F.lit(0).cast("long").alias("block"), F.concat("subroot", "top").alias("top"), "path")
        here = begin if down is None else begin.unionByName(down)
        if k:
            down = stored(_handed_down(own[k], here), "merkle-paths")
        else:
            parts.append(_with_paths(own[0], here))
    return parts[0].mapInArrow(_proofs, _OUT)


_OUT = ("id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _proofs(batches):
    """Rows of the documents from the lowest blocks and the paths of their roots."""
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    size = 9 + DIGEST
    for b in (big.slice(i, 64) for big in batches for i in range(0, big.num_rows, 64)):
        cols = [b.column(c).to_pylist() for c in ("n", "height", "nodes", "extra", "top", "path")]
        for n, tall, nodes, extra, top, path in zip(*cols):
            own, rows = Block(tall, n, nodes), []
            subroot, root = top[:DIGEST].hex(), top[DIGEST:]
            above = proof(path)
            for i in range(n):
                e = extra[i * size:(i + 1) * size]
                inner = own.path(i)
                folded = fold(fold(e[9:], inner), path)
                rows.append((int.from_bytes(e[1:9], "big", signed=True) if e[0] else None, own.node(0, i).hex(), subroot,
                             root.hex(), sha256(proof(inner) + above).hexdigest(), folded.hex(), folded == root))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
