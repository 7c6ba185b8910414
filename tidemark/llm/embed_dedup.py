"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c or more lie within squared distance 2 - 2c. After a
rotation (which spreads the variance over all coordinates) the vector is cut
into BLOCKS subspaces; if the distance keeps the budget, at least one block
keeps its proportional share of it. Each block is range-joined: a grid over its
first coordinates, a vector's home cell against all cells within the block's
radius. In a task the block distances of a cell's vectors come from a matrix
product; pairs within the block's share are verified by the exact cosine in
doubles, and a pair that several blocks find counts in the first of them.

Equal vectors are joined once. A cell with many home vectors is dealt out in
chunks, and a task keeps one chunk while the others pass by. Tasks return link
counts and, instead of all links, a forest that connects what they connect.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.components import connected_components

COSINE = 0.98
BLOCKS = 4
GRID = 2              # coordinates of a block that make its grid
CHUNK = 2048          # home vectors a task compares at once
SLACK = 1e-7          # for rounding in the first, coarse test


@cache
def rotation(size: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in doubles; scaled first, so that squares don't overflow."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _cuts(size: int) -> list[tuple[int, int]]:
    ends = [round(size * i / min(BLOCKS, size)) for i in range(min(BLOCKS, size) + 1)]
    return list(zip(ends, ends[1:]))


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row, always summed in the same order."""
    total = np.zeros(len(a))
    for c in range(a.shape[1]):
        d = a[:, c] - b[:, c]
        total += d * d
    return total


class Cell:
    """Home vectors of one cell and block, compared with passing batches."""

    def __init__(self, block: int, nodes: np.ndarray, weights: np.ndarray, vectors: np.ndarray, cosine: float):
        self.block, self.nodes, self.cosine = block, nodes, cosine
        self.unit = units(vectors)
        self.cuts = _cuts(vectors.shape[1])
        self.share = (2 - 2 * cosine) / len(self.cuts) + SLACK
        self.turned = self.unit @ rotation(vectors.shape[1])
        low, high = self.cuts[block]
        self.own = self.turned[:, low:high]
        self.norm = (self.own ** 2).sum(1)

    def links(self, nodes, vectors) -> tuple[np.ndarray, np.ndarray]:
        """(home row, passing row) of the links this block is the first to find."""
        unit = units(vectors)
        turned = unit @ rotation(vectors.shape[1])
        low, high = self.cuts[self.block]
        part = turned[:, low:high]
        near = self.norm[:, None] + (part ** 2).sum(1)[None, :] - 2 * (self.own @ part.T)
        a, b = np.nonzero(near <= self.share + SLACK)
        keep = self.nodes[a] != nodes[b]
        a, b = a[keep], b[keep]
        step = 1 << 18
        kept_a, kept_b = [], []
        for i in range(0, len(a), step):
            x, y = a[i:i + step], b[i:i + step]
            ok = _square(self.own[x], part[y]) <= self.share
            for p, q in self.cuts[:self.block]:
                ok &= _square(self.turned[x, p:q], turned[y, p:q]) > self.share
            ok &= (self.unit[x] * unit[y]).sum(axis=1) >= self.cosine
            kept_a.append(x[ok])
            kept_b.append(y[ok])
        return (np.concatenate(kept_a), np.concatenate(kept_b)) if kept_a else (a, b)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root), at most one a node, that connect what the links a-b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _placed(vectors: DataFrame, cosine: float) -> DataFrame:
    """Vectors in their home cells (side 0) and in all cells within a block's radius (side 1)."""
    def run(batches):
        for b in batches:
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes):
                own = b.filter(pa.array(sizes == size))
                v = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                turned = units(v) @ rotation(int(size))
                cuts = _cuts(int(size))
                radius = float(np.sqrt((2 - 2 * cosine) / len(cuts) + SLACK)) + SLACK
                side = 2 * radius
                for k, (low, high) in enumerate(cuts):
                    z = turned[:, low:min(high, low + GRID)]
                    if z.shape[1] < GRID:
                        z = np.hstack([z, np.zeros((len(z), GRID - z.shape[1]))])
                    home = np.floor(z / side).astype(np.int64)
                    first = np.floor((z - radius) / side).astype(np.int64)
                    last = np.floor((z + radius) / side).astype(np.int64)
                    out = [(home, np.arange(len(z)), 0)]
                    for i in range(2 ** GRID):
                        step = np.array([i >> g & 1 for g in range(GRID)])
                        cell = first + step
                        ok = (cell <= last).all(1)
                        out.append((cell[ok], np.nonzero(ok)[0], 1))
                    for cell, at, mark in out:
                        n = len(at)
                        idx = pa.array(at)
                        yield pa.record_batch(
                            [own.column("label").take(idx), own.column("size").take(idx),
                             pa.array(np.full(n, k, np.int32)), pa.array(cell[:, 0]), pa.array(cell[:, 1]),
                             pa.array(np.full(n, mark, np.int32)), own.column("node").take(idx),
                             own.column("weight").take(idx), own.column("v").take(idx)],
                            names=["label", "size", "block", "c0", "c1", "side", "node", "weight", "v"])

    return vectors.select("label", "size", "node", "weight", "v").mapInArrow(
        run, "label long, size long, block int, c0 long, c1 long, side int, node long, weight long, v array<double>")


_KEY = ["label", "size", "block", "c0", "c1", "chunk"]


def _joined(dealt: DataFrame, cosine: float) -> DataFrame:
    """(node, other, weight): link counts (other null) and forest links (weight 0)."""
    def run(batches):
        key, cell, home = None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            cols = np.stack([b.column(c).to_numpy().astype(np.int64) for c in [*_KEY, "side"]])
            edges = np.nonzero((cols[:, 1:] != cols[:, :-1]).any(0))[0] + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
                now, side = tuple(cols[:-1, i].tolist()), cols[-1, i]
                part = b.slice(i, j - i)
                if now != key:
                    key, cell, home = now, None, []
                if side == 0:
                    home.append(part)
                    continue
                if not home:
                    continue
                if cell is None:
                    pick = lambda c: np.concatenate([h.column(c).to_numpy() for h in home])
                    values = np.concatenate([h.column("v").flatten().to_numpy() for h in home])
                    cell = Cell(now[2], pick("node"), pick("weight"), values.reshape(-1, now[1]), cosine)
                nodes, weights = part.column("node").to_numpy(), part.column("weight").to_numpy()
                v = part.column("v").flatten().to_numpy().reshape(-1, now[1])
                for s in range(0, len(nodes), CHUNK):
                    x, y = cell.links(nodes[s:s + CHUNK], v[s:s + CHUNK])
                    if not len(x):
                        continue
                    got = np.bincount(x, weights[s + y], minlength=len(cell.nodes)).astype(np.int64)
                    hit = np.nonzero(got)[0]
                    low, root = forest(cell.nodes[x], nodes[s + y])
                    yield pa.record_batch(
                        [pa.array(np.concatenate([cell.nodes[hit], low])),
                         pa.array(np.concatenate([np.zeros(len(hit), np.int64), root]),
                                  mask=np.arange(len(hit) + len(root)) < len(hit)),
                         pa.array(np.concatenate([got[hit], np.zeros(len(low), np.int64)]))],
                        names=["node", "other", "weight"])

    spread = dealt.repartition(*_KEY).sortWithinPartitions(*_KEY, "side")
    return spread.mapInArrow(run, "node long, other long, weight long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per input row: id, n_links (other rows of the label linked
    directly), component (smallest id reachable, itself included) and kept (id
    is the component's name).

    Nulls: vectors that are null, empty, zero or hold null or non-finite parts,
    and rows without label, link with nothing. Vectors of different lengths are
    never compared. Repeated rows are rows of their own and link with each
    other. A null id never names a component. Equal vectors of a label are told
    by two 64-bit hashes; each such vector gets a number of its own as node.
    Other columns are ignored. An empty table gives an empty result.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = (F.col(label_col).isNotNull() & (F.size(v) > 0) & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"),
        F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("k1", F.when(F.col("fine"), F.xxhash64("label", "v"))).withColumn(
        "k2", F.when(F.col("fine"), F.xxhash64(F.lit(7), "label", "v")))
    good = rows.where("fine")
    each = good.groupBy("label", "k1", "k2").agg(F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    # Numbered as they are stored: later reads see the same numbers.
    each = stored(each.withColumn("size", F.size("v").cast("long")).withColumn(
        "node", F.monotonically_increasing_id()), "vectors")

    placed = stored(_placed(each, cosine), "cells")
    cells = _KEY[:-1]
    crowded = (placed.where("side = 0").groupBy(*cells).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
               .select(*cells, F.ceil(F.col("n") / CHUNK).cast("long").alias("chunks")))
    dealt = placed.join(crowded, cells, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    homes = dealt.where("side = 0").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    others = dealt.where("side = 1").withColumn("chunk", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("chunks") - 1)))
    found = stored(_joined(homes.unionByName(others).drop("chunks"), cosine), "links")

    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("weight").alias("links"))
    roots = connected_components(found.where("other IS NOT NULL").select(
        F.col("node").alias("a"), F.col("other").alias("b")))
    about = (each.select("node", "k1", "k2", "weight").join(counts, "node", "left").join(roots, "node", "left")
             .select("k1", "k2", F.coalesce("root", "node").alias("root"),
                     (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    slim = rows.select("id", "k1", "k2")
    named = slim.join(about, ["k1", "k2"], "left")
    names = named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("name"))
    out = named.join(names, "root", "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("name"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))
