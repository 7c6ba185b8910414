"""Repeated byte strings over a corpus, by distributed prefix doubling.

A window is a string of ``length`` bytes; a byte goes if it lies in a window
that also starts anywhere else. Ranking every position would move each byte of
the corpus several times, so the doubling runs over positions the content
chooses: each window is owned by its anchor, the start of the least 32-byte
hash among its first ``reach`` starts. Equal windows have equal anchors, and
anchors own runs of consecutive windows.

Rounds (a rank is the hash of a prefix; Spark groups the (rank, rank at the
offset) pairs and drops what is unique):

1. rank of the 64 bytes at the anchor, paired with the rank 64 bytes on: a
   unique pair (128 bytes, which every owned window holds) ends the anchor;
2. surviving anchors' windows fall in two parts: near ones hold 256 bytes from
   the anchor on, far ones 144 bytes before it. Each part pairs the rank of the
   128 bytes with the rank of the next 128, or of those before;
3. the parts' ranks are paired with the rank of the part's block, all bytes of
   its windows and so past the threshold: a repeated block is repeated as a
   whole, a unique rank ends the part;
4. where a rank has several blocks, their windows are ranked one by one.

Texts are kept once each in a bucketed table, so later rounds move ranks and
not texts. Exact copies are known from their keys. Counting combines on the
map side, and the counts are stored before they are joined: then both sides of
the join are plain exchanges, which AQE splits, so a passage that a third of
the documents share is not one task's work.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import run_dir, stored

LENGTH = 400
REACH = 272          # owned windows start at most this far before the anchor
GRAM = 32            # bytes hashed to choose anchors
FIRST = 64           # bytes of the first rank at most; the next covers twice as many
LEAST_FIRST = 16
SEGMENT = 1 << 18    # windows handled at once, which bounds a task's memory
TOGETHER = 4000      # blocks of a rank compared inside one task; more go by window
BUCKET_BYTES = 32 << 20

# Two polynomial hashes modulo 2^64: multipliers and byte values are arbitrary odd numbers.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def _tables(which: int, size: int) -> tuple:
    """Powers of the base, of its inverse, and the value of each byte."""
    base = _BASES[which]
    power, back = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    value = np.random.default_rng(which).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.multiply.accumulate(power), np.multiply.accumulate(back), value


class Hashes:
    """Hash of any substring of a buffer."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        power, self.back, value = _tables(which, max(1 << 19, 1 << len(buf).bit_length()))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(value[buf] * power[:len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    rest = width - have
    return np.minimum(v[:len(v) - rest], v[rest:]) if rest else v


def _buffers(texts: list[bytes], length: int):
    """(buffer, rows, row starts in the buffer, byte offset in the row's text) of
    at most about SEGMENT windows each; a long text comes in several."""
    held: list = []
    size = 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), SEGMENT):
            piece = text[at:at + SEGMENT + length - 1]
            if len(piece) < length:
                continue
            if held and size + len(piece) > SEGMENT + length:
                yield _joined(held)
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple:
    sizes = np.array([len(p) for _, _, p in held])
    starts = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    return buf, np.array([r for r, _, _ in held]), starts, sizes, np.array([a for _, a, _ in held])


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them) for every element, end to end."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def first_rank(length: int) -> int:
    """Bytes of the first rank: four of them and a gram fit into a window."""
    return min(FIRST, (length - GRAM) // 4)


def runs(buf, starts, sizes, length: int, h: Hashes) -> tuple:
    """(piece, low, high, anchor) of each run of windows with one anchor; positions in buf."""
    reach = min(REACH, length - 2 * first_rank(length) + 1)
    count = sizes - length + 1
    window = _spread(starts, count)
    piece = np.repeat(np.arange(len(starts)), count)
    gram = h(np.arange(len(buf) - GRAM + 1), GRAM) * np.uint64(0xD6E8FEB86659FD93)
    order = (gram >> np.uint64(24) << np.uint64(24)) | np.arange(len(gram), dtype=np.uint64)
    least = _sliding_min(order, reach)[window]
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(anchor)) - 1
    return piece[first], window[first], window[last], anchor[first]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _each_run(texts: list[bytes], length: int):
    """Per buffer: its hashes, and (row, low in the text, windows, low in the
    buffer, anchor in the buffer) of every run."""
    for buf, rows, starts, sizes, offsets in _buffers(texts, length):
        h = Hashes(buf)
        piece, low, high, anchor = runs(buf, starts, sizes, length, h)
        yield buf, h, rows[piece], low - starts[piece] + offsets[piece], high - low + 1, low, anchor


def _rank(h: Hashes, anchor: np.ndarray, first: int) -> np.ndarray:
    return _mix(h(anchor, first), h(anchor + first, first))


def _batched(batches, columns: dict, rows):
    """Run ``rows(texts, batch)`` on each batch; it yields dicts of arrays."""
    for b in batches:
        texts = b.column("text").to_pylist()
        for out in rows(texts, b):
            yield pa.record_batch([out[c] for c in columns], names=list(columns))


def _ranked(texts: DataFrame, length: int) -> DataFrame:
    def rows(own, b):
        k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
        for _, h, row, low, _, _, anchor in _each_run(own, length):
            yield {"r": _signed(_rank(h, anchor, first_rank(length))), "k1": pa.array(k1[row]), "k2": pa.array(k2[row]),
                   "low": pa.array(low.astype(np.int64))}

    cols = {"r": 0, "k1": 0, "k2": 0, "low": 0}
    return texts.select("k1", "k2", "text").mapInArrow(
        lambda it: _batched(it, cols, rows), "r long, k1 long, k2 long, low long")


def _parts(h: Hashes, row, low, n, at, anchor, length: int) -> tuple:
    """The runs' near and far parts: (rank, row, low, n, at, anchor). A near
    part's rank covers four first ranks (256 bytes) from the anchor on, a far
    part's two from it on and the rest of the window before it."""
    one = first_rank(length)
    before = length - 4 * one
    cut = np.clip(anchor - before - at, 0, n)      # windows in the far part
    out = []
    for first, count, far in ((cut, n - cut, False), (np.zeros_like(cut), cut, True)):
        ok = count > 0
        a = anchor[ok]
        if far:
            rank = _mix(_rank(h, a, one), h(a - before, before)) ^ np.uint64(1)
        else:
            rank = _mix(_rank(h, a, one), _rank(h, a + 2 * one, one))
        out.append((rank, row[ok], (low + first)[ok], count[ok], (at + first)[ok], a))
    return tuple(np.concatenate(x) for x in zip(*out))


def _marked(texts, batch, length: int, parts: bool):
    """Of each buffer the runs' parts, where the batch's column ``lows`` lists
    the run (or, with ``parts``, the part) by its first window."""
    lists = batch.column("lows")
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row_of = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    wanted = np.sort((row_of.astype(np.int64) << 40) | flat)
    for buf, h, row, low, n, at, anchor in _each_run(texts, length):
        def listed(row, low):
            mine = (row.astype(np.int64) << 40) | low
            return wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine

        if not parts:
            ok = listed(row, low)
            row, low, n, at, anchor = row[ok], low[ok], n[ok], at[ok], anchor[ok]
        found = _parts(h, row, low, n, at, anchor, length)
        if parts:
            ok = listed(found[1], found[2])
            found = tuple(x[ok] for x in found)
        yield buf, h, *found


def _blocks(texts: DataFrame, length: int) -> DataFrame:
    """Rank and block hashes of the listed runs' parts (column ``lows`` per text)."""
    def rows(own, b):
        k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
        for buf, h, rank, row, low, n, at, anchor in _marked(own, b, length, False):
            second = Hashes(buf, 1)
            shape = ((anchor - at).astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
            span = n + length - 1
            yield {"r": _signed(rank), "b1": _signed(_mix(h(at, span), shape)),
                   "b2": _signed(_mix(second(at, span), shape)), "k1": pa.array(k1[row]),
                   "k2": pa.array(k2[row]), "low": pa.array(low.astype(np.int64)),
                   "n": pa.array(n.astype(np.int32))}

    cols = dict.fromkeys(("r", "b1", "b2", "k1", "k2", "low", "n"))
    return texts.select("k1", "k2", "text", "lows").mapInArrow(
        lambda it: _batched(it, cols, rows),
        "r long, b1 long, b2 long, k1 long, k2 long, low long, n int")


def _slices(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the listed parts' blocks, by rank."""
    def rows(own, b):
        k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
        for buf, h, rank, row, low, n, at, anchor in _marked(own, b, length, True):
            raw = buf.tobytes()
            cut = [raw[a:a + m + length - 1] for a, m in zip(at.tolist(), n.tolist())]
            yield {"r": _signed(rank), "k1": pa.array(k1[row]), "k2": pa.array(k2[row]),
                   "low": pa.array(low.astype(np.int64)), "block": pa.array(cut, pa.binary())}

    cols = dict.fromkeys(("r", "k1", "k2", "low", "block"))
    return texts.select("k1", "k2", "text", "lows").mapInArrow(
        lambda it: _batched(it, cols, rows),
        "r long, k1 long, k2 long, low long, block binary")


def _window_hashes(blocks: list[bytes], length: int):
    """(row, start in the block, two hashes) of all windows of short blocks."""
    sizes = np.array([len(x) for x in blocks])
    starts = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(blocks), np.uint8)
    window = _spread(starts, sizes - length + 1)
    row = np.repeat(np.arange(len(blocks)), sizes - length + 1)
    return row, window - starts[row], Hashes(buf)(window, length), Hashes(buf, 1)(window, length)


def _block_chunks(blocks):
    """Row ranges of about SEGMENT bytes (a block is at most length + REACH bytes)."""
    size, first = 0, 0
    for i, x in enumerate(blocks):
        if size + len(x) > SEGMENT and i > first:
            yield first, i
            size, first = 0, i
        size += len(x)
    if first < len(blocks):
        yield first, len(blocks)


def _together(slices: DataFrame, length: int) -> DataFrame:
    """Repeated windows where a rank has few blocks: whole ranks meet in a task
    and are compared there, a bounded chunk of ranks at a time."""
    def compare(held):
        blocks = [x["block"] for x in held]
        row, at, h1, h2 = _window_hashes(blocks, length)
        rank = np.array([x["r"] for x in held], np.int64)[row]
        order = np.lexsort((h2, h1, rank))
        same = ((rank[order][1:] == rank[order][:-1]) & (h1[order][1:] == h1[order][:-1])
                & (h2[order][1:] == h2[order][:-1]))
        found = np.zeros(len(row), bool)
        found[order[1:]] |= same
        found[order[:-1]] |= same
        row, at = row[found], at[found]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(row)) - 1
        if not len(first):
            return None
        own = row[first]
        pick = lambda c: np.array([x[c] for x in held], np.int64)[own]
        return pa.record_batch(
            [pa.array(pick("k1")), pa.array(pick("k2")), pa.array(pick("low") + at[first]),
             pa.array((last - first + 1).astype(np.int32))], names=["k1", "k2", "low", "n"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for x in b.to_pylist():
                if size > SEGMENT and x["r"] != held[-1]["r"]:
                    if (out := compare(held)) is not None:
                        yield out
                    held, size = [], 0
                if held and (x["k1"], x["k2"], x["low"]) == (held[-1]["k1"], held[-1]["k2"], held[-1]["low"]):
                    continue
                held.append(x)
                size += len(x["block"])
        if held and (out := compare(held)) is not None:
            yield out

    return (slices.repartition("r").sortWithinPartitions("r", "k1", "k2", "low")
            .mapInArrow(run, "k1 long, k2 long, low long, n int"))


def _apart(slices: DataFrame, length: int) -> DataFrame:
    """Repeated windows where a rank has many blocks: one row per window, so
    that the rank's work spreads over the cluster."""
    def run(batches):
        for b in batches:
            blocks = b.column("block").to_pylist()
            k1, k2, low = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "low"))
            for i, j in _block_chunks(blocks):
                row, at, h1, h2 = _window_hashes(blocks[i:j], length)
                row = row + i
                yield pa.record_batch([_signed(h1), _signed(h2), pa.array(k1[row]), pa.array(k2[row]),
                                       pa.array(low[row] + at)], names=["h1", "h2", "k1", "k2", "low"])

    each = slices.select("k1", "k2", "low", "block").mapInArrow(
        run, "h1 long, h2 long, k1 long, k2 long, low long").distinct()
    again = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2")
    return each.join(again, ["h1", "h2"], "left_semi").select(
        "k1", "k2", "low", F.lit(1).alias("n"))


def _distinct_texts(keyed: DataFrame, length: int) -> DataFrame:
    """Each text of at least ``length`` bytes once, in a table bucketed by key
    in the shared folder. Repeats go on the map side first, where a task
    remembers a bounded number of keys, so copies do not pile up on one task."""
    spark = keyed.sparkSession
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(100_000, max(12, total // BUCKET_BYTES)))

    def unseen(batches):
        seen: set = set()
        for b in batches:
            keep = []
            for i, k in enumerate(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist())):
                if k not in seen:
                    if len(seen) < 1 << 19:
                        seen.add(k)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64())) if len(keep) < b.num_rows else b

    def first_of_each(batches):
        last = None
        for b in batches:
            keep = []
            for i, k in enumerate(zip(b.column("k1").to_pylist(), b.column("k2").to_pylist())):
                if k != last:
                    keep.append(i)
                last = k
            yield b.take(pa.array(keep, pa.int64())) if len(keep) < b.num_rows else b

    schema = "k1 long, k2 long, text binary"
    long_enough = keyed.where(F.octet_length("text") >= length).select(
        "k1", "k2", F.col("text").cast("binary").alias("text"))
    once = (long_enough.mapInArrow(unseen, schema).repartition(buckets, "k1")
            .sortWithinPartitions("k1", "k2").mapInArrow(first_of_each, schema))
    name = f"tidemark_texts_{uuid.uuid4().hex}"
    (once.write.bucketBy(buckets, "k1").option("path", run_dir(spark, "texts"))
     .option("compression", "zstd").format("parquet").saveAsTable(name))
    # The files stay bucketed for this frame; the catalog keeps no entry.
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return texts


def _listed(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts with the run starts that ``rows`` lists for them."""
    lists = rows.groupBy("k1", "k2").agg(F.collect_set("low").alias("lows"))
    return texts.join(lists.hint("shuffle_hash"), ["k1", "k2"])


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, low, n): runs of n windows from byte ``low`` of text (k1, k2)
    that start anywhere else too. ``texts`` holds each text once."""
    ranked = stored(_ranked(texts, length), "ranks")
    again = stored(ranked.groupBy("r").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("r"), "again")
    # Both sides come from tables, so AQE can deal a very common rank to many tasks.
    alive = ranked.join(again, "r", "left_semi").select("k1", "k2", "low")

    blocks = stored(_blocks(_listed(texts, alive), length), "blocks")
    kinds = stored(blocks.groupBy("r", "b1", "b2").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("k1", "k2", "low")).alias("one")), "kinds")
    many = stored(kinds.groupBy("r").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1"), "many")
    whole = blocks.join(kinds.where("copies > 1").select("r", "b1", "b2"), ["r", "b1", "b2"], "left_semi")
    # One block of each kind stands for its copies.
    open_ = stored(kinds.join(many, "r").select("one.*", "variants"), "open")

    def windows(which: DataFrame) -> DataFrame:
        return _slices(_listed(texts, which), length)

    few = _together(windows(open_.where(F.col("variants") <= TOGETHER)), length)
    hot = _apart(windows(open_.where(F.col("variants") > TOGETHER)), length)
    return whole.select("k1", "k2", "low", "n").union(few).union(hot)


def _spans(low: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged [start, end) byte ranges of the windows' bytes."""
    order = np.argsort(low, kind="stable")
    start, end = low[order], np.maximum.accumulate((low + n + length - 1)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.nonzero(new)[0]
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _cut(texts: DataFrame, windows: DataFrame, length: int, whole: int, words: int) -> DataFrame:
    """What remains of each text that has repeated windows: of its bytes the
    hash, and as text the whole characters of each remaining piece. A repeated
    run goes if it has ``whole`` bytes or more than ``words`` words."""
    def run(batches):
        for b in batches:
            out = []
            for k1, k2, text, spans in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text", "spans"))):
                low = np.array([s["low"] for s in spans], np.int64)
                n = np.array([s["n"] for s in spans], np.int64)
                start, end = _spans(low, n, length)
                kept, at, gone = [], 0, 0
                for s, e in zip(start.tolist(), end.tolist()):
                    if e - s < whole and len(text[s:e].split()) <= words:
                        continue
                    kept.append(text[at:s])
                    at, gone = e, gone + 1
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((k1, k2, len(text) - len(rest), gone, hashlib.sha256(rest).hexdigest(),
                            "".join(x.decode(errors="ignore") for x in kept)))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    lists = windows.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "n")).alias("spans"))
    return texts.join(lists.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(
        run, "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept string")


def _text(text_col: str):
    return F.coalesce(F.col(text_col), F.lit(""))


def _key(text) -> tuple:
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def _fates(docs: DataFrame, text_col: str, length: int, with_text: bool, whole: int = 0, words: int = 0) -> DataFrame:
    """(_k1, _k2, _copies, _n_removed, _n_spans, _kept_sha256[, _kept]) of each
    text that has copies or repeated windows."""
    if first_rank(length) < LEAST_FIRST:
        raise ValueError(f"length must be at least {4 * LEAST_FIRST + GRAM}")
    text = _text(text_col)
    k1, k2 = _key(text)
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    texts = _distinct_texts(keyed, length)
    cut = _cut(texts, repeated_windows(texts, length), length, whole, words)
    if not with_text:
        cut = cut.drop("kept")
    cut = stored(cut.where("n_spans > 0"), "cut")
    copied = keyed.select("k1", "k2").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    both = cut.join(copied, ["k1", "k2"], "full")
    return both.select(*[F.col(c).alias(f"_{c}") for c in ("k1", "k2", "copies", *cut.columns[2:])])


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH,
                   keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the columns ``keep`` (default: all), n_bytes,
    n_removed, n_spans (maximal removed runs) and kept_sha256 (of the remaining
    bytes).

    Nulls: a null text counts as empty; other columns may be null. Texts shorter
    than ``length`` keep all. Of copies, all bytes go, also where rows repeat
    wholly. Columns in ``keep`` must not have the names of the added ones. An
    empty table gives an empty result.
    """
    fates = _fates(docs, text_col, length, False)
    names = list(docs.columns) if keep is None else keep
    text = _text(text_col)
    k1, k2 = _key(text)
    left = docs.select(F.struct(*names).alias("_doc"), k1.alias("_a1"), k2.alias("_a2"),
                       F.octet_length(text).cast("long").alias("_bytes"), F.sha2(text, 256).alias("_whole"))
    joined = left.join(fates, (F.col("_a1") == F.col("_k1")) & (F.col("_a2") == F.col("_k2")), "left")
    gone = (F.col("_copies") > 1) & (F.col("_bytes") >= length)
    zero = F.lit(0).cast("long")
    return joined.select(
        "_doc.*", F.col("_bytes").alias("n_bytes"),
        F.when(gone, F.col("_bytes")).otherwise(F.coalesce("_n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("_n_spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(
            F.coalesce("_kept_sha256", "_whole")).alias("kept_sha256"))


def cut_repeats(docs: DataFrame, text_col: str = "text", chars_col: str | None = None,
                length: int = LENGTH, whole: int = 0, words: int = 0) -> DataFrame:
    """The input's rows and columns, without the bytes of repeats in the text (a
    character that loses a byte goes whole); ``chars_col`` follows the text.

    ``length`` is the least repeated string that is looked for. Of the maximal
    runs that such strings cover, those go that have at least ``whole`` bytes or
    more than ``words`` words (runs between white space); by default all do.
    Nulls, copies and empty tables as in remove_repeats."""
    fates = _fates(docs, text_col, length, True, whole, words)
    text = _text(text_col)
    k1, k2 = _key(text)
    left = docs.select(F.struct("*").alias("_doc"), k1.alias("_a1"), k2.alias("_a2"),
                       ((F.octet_length(text) >= max(length, whole))
                        | ((F.octet_length(text) >= length)
                           & (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) > words))).alias("_long"))
    joined = left.join(fates, (F.col("_a1") == F.col("_k1")) & (F.col("_a2") == F.col("_k2")), "left")
    rest = F.when((F.col("_copies") > 1) & F.col("_long"), F.lit("")).otherwise(F.col("_kept"))
    out = joined.select("_doc", rest.alias("_rest"))
    doc = F.col("_doc")
    new = {text_col: F.coalesce("_rest", doc[text_col])}
    if chars_col:
        new[chars_col] = F.when(F.col("_rest").isNull(), doc[chars_col]).otherwise(
            F.char_length("_rest").cast(docs.schema[chars_col].dataType))
    return out.select(*[new.get(c, doc[c]).alias(c) for c in docs.columns])
