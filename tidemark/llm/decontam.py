"""Benchmark decontamination by winnowing, in DataFrame functions only.

The fingerprint of ten consecutive words is the least hash among their six
5-grams (k = 5, window = 6, so k + window - 1 = 10). A text's fingerprints are
those of all its ten-word windows; neighbours mostly share one, so a text keeps
about two in seven. Any shared span of ten words or more holds a shared window
and thus a shared fingerprint: none is missed. Texts that share a fingerprint
with an item are compared window by window (a 128-bit hash of the words), and
the windows found are joined to spans. Items shorter than a window are looked
for as one window of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

WINDOW = 10
GRAM = 5
# The benchmark's windows are broadcast only up to this many rows (of six numbers
# each; the items' ids lie apart); beyond it the same joins shuffle.
BROADCAST_ROWS = 100_000
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of the text: A-Z lower-cased (only those), ASCII separators apart."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _over(df: DataFrame, values: str, n: int, fn, out: str) -> DataFrame:
    """Adds ``out``: ``fn`` over every n consecutive values of an array column.
    Arrays over 2, 4, ... values come from neighbours in the one before, and
    those that n consists of are put together, each value once."""
    def put(df, name, left, right, by, wide):
        size = F.greatest(F.size(values) - wide + 1, F.lit(0))
        return df.withColumn(name, F.zip_with(
            F.slice(left, F.lit(1), size), F.slice(right, F.lit(by + 1), size), fn))

    width, power, made, done = 1, values, None, 0
    while True:
        if n & width:
            if made is None:
                made, done = power, width
            else:
                df = put(df, f"_{out}_{done + width}", made, power, done, done + width)
                made, done = f"_{out}_{done + width}", done + width
        if done == n:
            return df.withColumn(out, F.col(made))
        df = put(df, f"_{out}_2x{width}", power, power, width, 2 * width)
        power, width = f"_{out}_2x{width}", 2 * width


def _with_keys(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``keys_n`` for each length n of ``lengths``: the winnowed fingerprint
    of each ten-word window of ``ws``; for less than ten, the hash of each n words."""
    df = df.withColumn("_hash", F.transform("ws", lambda w: F.xxhash64(w)))
    for n in lengths:
        if n < WINDOW:
            df = _over(df, "_hash", n, lambda a, b: F.xxhash64(a, b), f"keys_{n}")
        else:
            df = _over(df, "_hash", GRAM, lambda a, b: F.xxhash64(a, b), "_grams")
            df = _over(df, "_grams", WINDOW - GRAM + 1, lambda a, b: F.least(a, b), f"keys_{n}")
    return df


def item_windows(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored (len, h1, h2, key, s1, s2), each distinct window with a key of
    the set of its items, and (s1, s2, id), the items of each such set once."""
    own = items.select(F.col(id_col).cast("string").alias("id"), words(F.col(text_col)).alias("ws"))
    own = own.where(F.size("ws") > 0).withColumn("len", F.least(F.size("ws"), F.lit(WINDOW)))
    cut = own.select("id", "len", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("ws") - F.col("len") + 1),
        lambda i: F.slice("ws", i, F.col("len")))).alias("ws"))
    keys = F.coalesce(*[F.when(F.col("len") == n, F.get(f"keys_{n}", F.lit(0))) for n in range(1, WINDOW + 1)])
    found = _with_keys(cut, list(range(1, WINDOW + 1))).select(
        "len", F.xxhash64("ws").alias("h1"), F.xxhash64(F.lit(11), "ws").alias("h2"), keys.alias("key"), "id")
    pairs = stored(found.distinct(), "pairs")
    # The ids of a window are never gathered: their hashes are summed without carry, in any order.
    named = F.col("id").isNotNull()
    key = [F.coalesce(F.bit_xor(F.when(named, F.xxhash64(F.lit(seed), "id"))), F.lit(0).cast("long")).alias(name)
           for seed, name in ((3, "s1"), (5, "s2"))]
    wins = stored(pairs.groupBy("len", "h1", "h2", "key").agg(*key), "windows")
    # One window stands for all that have its set.
    ones = wins.groupBy("s1", "s2").agg(F.min(F.struct("len", "h1", "h2")).alias("w")).select("s1", "s2", "w.*")
    sets = pairs.where(named).join(ones, ["len", "h1", "h2"]).select("s1", "s2", "id")
    return wins, stored(sets, "sets")


def _hits(texts: DataFrame, wins: DataFrame, n: int, hint) -> DataFrame:
    """(k1, k2, start, stop, s1, s2) of windows of n words; texts: (k1, k2, ws)."""
    at = F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.struct(
        i.alias("i"), F.xxhash64(F.slice("ws", i, n)).alias("h1"),
        F.xxhash64(F.lit(11), F.slice("ws", i, n)).alias("h2")))
    each = texts.where(F.size("ws") >= n).select("k1", "k2", F.explode(at).alias("w"))
    mine = wins.where(F.col("len") == n).select("h1", "h2", "s1", "s2")
    return each.select("k1", "k2", "w.*").join(hint(mine), ["h1", "h2"]).select(
        "k1", "k2", F.col("i").alias("start"), (F.col("i") + n).alias("stop"), "s1", "s2")


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the columns ``keep`` (default: all), n_words,
    n_hit (words inside any occurrence of an item's window), n_items,
    items_sha256 (of the sorted item ids, comma-joined) and contaminated.

    Nulls: a null text has no words and neither contaminates nor is hit; a null
    item id counts as no id. Equal texts, repeated rows too, get equal results;
    repeated items count once. Only the named columns are read; one that has the
    name of an added column gives way to it. Empty tables: no document gives
    no row; no item leaves every document clean.
    """
    wins, sets = item_windows(items, item_id, item_text)
    n_rows = wins.count()
    hint = F.broadcast if n_rows <= BROADCAST_ROWS else (lambda df: df)
    lengths = [r[0] for r in wins.select("len").distinct().collect()]  # at most ten

    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")
    own = docs.select(k1, k2, words(F.col(text_col)).alias("ws"))
    # All lengths in one read of the texts; equal keys only propose, windows decide.
    keyed = _with_keys(own, lengths).select("k1", "k2", F.explode(F.array_distinct(
        F.concat(F.array().cast("array<bigint>"), *[F.col(f"keys_{n}") for n in lengths]))).alias("key"))
    suspects = keyed.join(hint(wins.select("key").distinct()), "key", "left_semi").select("k1", "k2")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    kept = [F.struct(*[F.col(f"`{c}`") for c in names]).alias("_kept")] if names else []
    # Table lookups per character: ranges in one class took over ten times the time.
    pattern = r"[\p{Alnum}\P{ASCII}]+"
    base = docs.select(*kept, F.regexp_count(text, F.lit(pattern)).cast("long").alias("n_words"),
                       k1.alias("_k1"), k2.alias("_k2"))
    names = ["_kept.*"] if names else []
    none = F.sha2(F.lit("").cast("binary"), 256)
    if not lengths:
        return base.select(*names, "n_words", F.lit(0).cast("long").alias("n_hit"),
                           F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"),
                           F.lit(False).alias("contaminated"))
    suspects = stored(suspects.distinct(), "suspects")
    # Copies of a text give the same hits; the sets below keep one of each.
    full = docs.select(k1, k2, F.col(text_col).alias("text")).join(suspects, ["k1", "k2"], "left_semi")
    full = full.select("k1", "k2", words(F.col("text")).alias("ws"))
    hits = None
    for n in lengths:
        got = _hits(full, wins, n, hint)
        hits = got if hits is None else hits.union(got)
    per_text = hits.groupBy("k1", "k2").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.array_sort(F.collect_set(F.struct("s1", "s2"))).alias("sets"))
    merged = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["end"], x["start"]))).alias("n"),
            F.greatest(acc["end"], x["stop"]).alias("end")))
    per_text = stored(per_text.select(
        "k1", "k2", merged["n"].cast("long").alias("_n_hit"), "sets",
        F.xxhash64("sets").alias("c1"), F.xxhash64(F.lit(7), "sets").alias("c2")), "hits")
    # Texts with the same sets have the same items, which are joined by shuffle once.
    groups = per_text.groupBy("c1", "c2").agg(F.first("sets").alias("sets"))
    ids = (groups.select("c1", "c2", F.explode("sets").alias("s")).select("c1", "c2", "s.*")
           .join(sets, ["s1", "s2"]).select("c1", "c2", "id").distinct()
           .groupBy("c1", "c2").agg(F.array_sort(F.collect_set("id")).alias("ids")))
    ids = ids.select("c1", "c2", F.size("ids").cast("long").alias("_n_items"),
                     F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("_items"))
    per_text = per_text.drop("sets").join(ids, ["c1", "c2"], "left").select(
        F.col("k1").alias("_h1"), F.col("k2").alias("_h2"), "_n_hit", "_n_items", "_items")
    joined = base.join(per_text, (F.col("_k1") == F.col("_h1")) & (F.col("_k2") == F.col("_h2")), "left")
    n_hit = F.coalesce("_n_hit", F.lit(0).cast("long"))
    return joined.select(*names, "n_words", n_hit.alias("n_hit"),
                         F.coalesce("_n_items", F.lit(0).cast("long")).alias("n_items"),
                         F.coalesce("_items", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """The input's rows that no window hits, columns as they are."""
    own = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text"))
    found = find(own, items, "_text", item_id, item_text, keep=["_doc"])
    return found.where(~F.col("contaminated")).select("_doc.*")
