"""Nearest neighbours by largest inner product: a block matrix join on int8 codes.

Queries and candidates are cut into blocks; a task multiplies one tile. Every
vector x is stored as one int8 code a component times its scale, x = s c + e,
with the norm of the rest e. The tile's product of codes gives each inner
product up to |s_q c_q| |e_x| + |e_q| |x|, so a pair whose upper bound falls
below the k-th best lower bound (later: the k-th best exact score) of its query
is out. What survives is recomputed from the original vectors in doubles.
A query block keeps one heap a query while the candidates of the tile stream
by; heaps of one query from different tiles are merged at the end.

The codes' products are summed in float32 by the BLAS: they are whole numbers
under 2^24 up to 1040 components, so the sums are exact; longer vectors take
float64. Equal vectors are one row of a tile and stand for their ids.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stored

K = 20
QUERY_BLOCK = 16384          # query vectors that a task holds
CANDIDATE_BLOCK = 262144     # candidate vectors that pass by in one tile
ROWS, COLUMNS = 1024, 2048   # a tile's product is made in pieces of this size
EXACT_FLOAT32 = 1040         # 127 * 127 * 1040 < 2^24
TINY, HUGE = 1e-15, 1e15     # norms beyond these take float64


class Codes:
    """int8 codes of vectors, with what bounds their error."""

    def __init__(self, vectors: np.ndarray):
        self.v = vectors
        with np.errstate(all="ignore"):
            top = np.abs(vectors).max(axis=1)
            self.scale = top / 127
            code = np.rint(vectors / np.where(self.scale > 0, self.scale, 1)[:, None])
            self.code = np.clip(code, -127, 127).astype(np.int8)
            kept = self.code.astype(np.float64) * self.scale[:, None]
            self.norm = np.sqrt((vectors ** 2).sum(1))
            self.coded = np.sqrt((kept ** 2).sum(1))
            self.rest = np.sqrt(((vectors - kept) ** 2).sum(1))

    def plain(self) -> bool:
        """Whether float32 holds all bounds of these vectors."""
        return (self.v.shape[1] <= EXACT_FLOAT32 and bool(np.isfinite(self.norm).all())
                and len(self.norm) > 0 and self.norm.min() > TINY and self.norm.max() < HUGE)

    def part(self, a: int, b: int) -> "Codes":
        out = object.__new__(Codes)
        for name in ("v", "scale", "code", "norm", "coded", "rest"):
            setattr(out, name, getattr(self, name)[a:b])
        return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in doubles, summed from the first component on."""
    total = np.zeros(len(a))
    for c in range(a.shape[1]):
        total += a[:, c] * b[:, c]
    return total


class Heaps:
    """The k best candidates of each query of a block: score, then smallest id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = Codes(queries), k
        self.score = np.full((len(queries), k), -np.inf)
        self.node = np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(self, vectors: np.ndarray, nodes: np.ndarray) -> None:
        c = Codes(vectors)
        wide = np.float32 if self.q.plain() and c.plain() else np.float64
        for i in range(0, len(self.score), ROWS):
            for j in range(0, len(nodes), COLUMNS):
                self._piece(i, min(i + ROWS, len(self.score)), c.part(j, j + COLUMNS), nodes[j:j + COLUMNS], wide)

    def _piece(self, a: int, b: int, c: Codes, nodes: np.ndarray, wide) -> None:
        q = self.q.part(a, b)
        with np.errstate(all="ignore"):
            # In units of the query's scale: product of codes x candidate's scale,
            # plus or minus the bound (two factors a pair, with room for rounding).
            room = 1e-6 if wide is np.float32 else 1e-14 * (q.v.shape[1] + 8)
            product = q.code.astype(wide) @ c.code.astype(wide).T
            product *= c.scale.astype(wide)[None, :]
            mine = np.stack([q.coded / q.scale, (q.rest + room * q.norm) / q.scale], 1).astype(wide)
            theirs = np.stack([c.rest + room * c.norm, c.norm], 0).astype(wide)
            slack = mine @ theirs
            least = self.score[a:b, -1] / q.scale
            if len(nodes) >= self.k and not np.isfinite(least).all():
                lower = np.partition(product - slack, len(nodes) - self.k, axis=1)[:, len(nodes) - self.k]
                least = np.fmax(least, lower)
            product += slack
            # Written so that bounds which are no numbers let their pair through.
            x, y = np.nonzero(~(product < (least - room * np.abs(least))[:, None].astype(wide)))
        if not len(x):
            return
        exact = np.concatenate([inner(q.v[x[s:s + 65536]], c.v[y[s:s + 65536]]) for s in range(0, len(x), 65536)])
        at = a + x
        held = np.unique(at)
        rows = np.concatenate([np.repeat(held, self.k), at])
        score = np.concatenate([self.score[held].ravel(), exact])
        node = np.concatenate([self.node[held].ravel(), nodes[y]])
        order = np.lexsort((node, -score, rows))
        rows, score, node = rows[order], score[order], node[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < self.k
        self.score[rows[keep], rank[keep]] = score[keep]
        self.node[rows[keep], rank[keep]] = node[keep]


_RUN = "query long, node long, score double"
_TILE = ["size", "qb", "cb"]


def _tiles(dealt: DataFrame, k: int) -> DataFrame:
    """The heaps of each tile, a row an entry. ``dealt``: size, qb, cb, side (0:
    queries, which come first), node, v."""
    def run(batches):
        key, heaps, home, names = None, None, [], []

        def entries():
            if heaps is None:
                return
            q, r = np.nonzero(np.isfinite(heaps.score) | (heaps.node < np.iinfo(np.int64).max))
            ids = np.concatenate(names)
            for s in range(0, len(q), 100_000):
                x, y = q[s:s + 100_000], r[s:s + 100_000]
                yield pa.record_batch([pa.array(ids[x]), pa.array(heaps.node[x, y]), pa.array(heaps.score[x, y])],
                                      names=["query", "node", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = np.stack([b.column(c).to_numpy().astype(np.int64) for c in [*_TILE, "side"]])
            edges = np.nonzero((cols[:, 1:] != cols[:, :-1]).any(0))[0] + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
                now, side, part = tuple(cols[:-1, i].tolist()), cols[-1, i], b.slice(i, j - i)
                if now != key:
                    yield from entries()
                    key, heaps, home, names = now, None, [], []
                nodes = part.column("node").to_numpy()
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, now[0])
                if side == 0:
                    home.append(v)
                    names.append(nodes)
                elif home:
                    if heaps is None:
                        heaps = Heaps(np.concatenate(home), k)
                    heaps.offer(v, nodes)
        yield from entries()

    return dealt.repartition(*_TILE).sortWithinPartitions(*_TILE, "side").select(
        *_TILE, "side", "node", "v").mapInArrow(run, _RUN)


def _merged(entries: DataFrame, k: int) -> DataFrame:
    """The k best entries of each query over all its tiles, by a heap."""
    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in ("query", "node", "score")])

        out = []
        for query, own in groupby(rows(), key=lambda r: r[0]):
            best = heapq.nsmallest(k, own, key=lambda r: (-r[2], r[1]))
            out += best
            if len(out) > 50_000:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["query", "node", "score"])
                out = []
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["query", "node", "score"])

    return entries.repartition("query").sortWithinPartitions("query").mapInArrow(run, _RUN)


def usable(v) -> F.Column:
    """Not null, empty or zero, and all components finite."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: F.Column, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = K, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query id its k candidates
    of the largest inner product, ties to the smaller id; all candidates if there
    are fewer. ``is_query`` marks the query rows; candidates are all rows of
    another id.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without id, take no part. Vectors of different lengths are not compared.
    Rows that repeat count once, and of rows of one id with different vectors the
    one with the smallest vector (component by component). Other columns are
    ignored. An empty table gives an empty result.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # one zero
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("query")).where(
        F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.select("id", "v", F.coalesce("query", F.lit(False)).alias("query"), F.xxhash64("v").alias("k1"),
                       F.xxhash64(F.lit(7), "v").alias("k2"))

    # Ids with several vectors are rare, so they are looked for by hashes alone.
    doubled = stored(rows.select("id", "k1", "k2").distinct().groupBy("id").count().where("count > 1").select("id"), "knn-doubled")
    if doubled.limit(1).count():
        one = rows.join(doubled, "id", "left_semi").groupBy("id").agg(
            F.min(F.struct("v", "k1", "k2")).alias("m"), F.max("query").alias("query"))
        rows = rows.join(doubled, "id", "left_anti").unionByName(one.select("id", "m.v", "query", "m.k1", "m.k2"))

    # A distinct vector stands for its ids, of which a result needs the k + 1
    # smallest at most (the rank is limited before rows are shuffled).
    ranked = rows.select("k1", "k2", "id").distinct().withColumn("r", F.row_number().over(
        Window.partitionBy("k1", "k2").orderBy("id"))).where(F.col("r") <= k + 1)
    ids = ranked.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    each = rows.groupBy("k1", "k2").agg(F.first("v").alias("v")).join(ids, ["k1", "k2"])
    each = stored(each.select("k1", "k2", "v", "ids", F.size("v").cast("long").alias("size"),
                              F.col("ids")[0].alias("node")), "knn-vectors")
    asks = stored(rows.where("query").select("id", "k1", "k2").distinct(), "knn-asks")
    wanted = asks.select("k1", "k2").distinct()

    # Blocks: as many as the counts ask for, dealt by hash.
    counts = each.groupBy("size").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    q_blocks = max(1, -(-wanted.count() // query_block))
    c_blocks = max(1, -(-counts // candidate_block))
    # Enough tiles for the cluster's cores, as long as a candidate block is worth a task.
    tasks = each.sparkSession.sparkContext.defaultParallelism
    c_blocks = max(c_blocks, min(-(-tasks // q_blocks), max(1, counts // (4 * COLUMNS))))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = each.join(wanted, ["k1", "k2"], "left_semi").select(
        "size", F.pmod("k1", F.lit(q_blocks)).alias("qb"), all_of(c_blocks).alias("cb"), F.lit(0).alias("side"), "node", "v")
    passing = each.select(
        "size", all_of(q_blocks).alias("qb"), F.pmod("k2", F.lit(c_blocks)).alias("cb"), F.lit(1).alias("side"), "node", "v")
    best = _merged(stored(_tiles(held.union(passing), k + 1), "knn-heaps"), k + 1)

    # Ids of the best vectors: the k + 1 nearest rows of each distinct query vector.
    named = best.join(each.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    lists = named.groupBy("query", "score", "vec_id").agg(F.lit(1)).withColumn("r", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = lists.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("list"))
    lists = stored(lists.join(each.select(F.col("node").alias("query"), "k1", "k2"), "query").select("k1", "k2", "list"), "knn-lists")
    own = asks.join(lists, ["k1", "k2"])
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).alias("rank"), "x.vec_id", "x.score")
