"""Token ids in binary shards, compressed by a Re-Pair grammar.

Documents are range-partitioned by id and cut into shards of a few million
ids. In a shard, pairs of neighbouring ids become nonterminals, again and again
until no pair occurs twice; the shard stores its rules, the expanded length of each rule and
each document's place among the symbols and the ids, so any document or span of
ids is decoded without the rest. Pairs never cross documents.

File layout (little-endian): magic, eight int64 counts, then the arrays of
``_ARRAYS`` in order. A symbol's low 16 bits and its higher bits lie apart.
"""

from __future__ import annotations

import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import run_dir, stored
from tidemark.llm.files import new_file, open_file
from tidemark.sources.paths import qualified

MAGIC = b"TMREPAIR"
END_ID = 0
SHARD_IDS = 2_000_000       # a shard ends with the document that reaches this
PARTITION_BYTES = 16 << 20
# Pairs are replaced until none occurs this often in the shard. A rule takes 12 bytes (two symbols and the
# length of its expansion), each replaced pair saves a symbol of some 18 bits: from six places on a rule pays.
LEAST_COUNT = 6
CACHED_PIECES = 800_000
CALL_PIECES = 200           # pieces a call of the library takes: with more, its own offsets cost most of the time
BUCKET_BITS = 20            # hash buckets of pairs stay in a core's cache
_CHUNK_BYTES = 8 << 20

# White space as the pre-tokenizer's \s has it, fixed values.
_SPACE = ("[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
          "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
_NOT_PLAIN = f"^{_SPACE}|{_SPACE}$|[ \\n]{_SPACE}|{_SPACE}[ \\n]|<\\|endoftext\\|>"


class Encoder:
    """Ids of whole texts by the tokenizers library, with a cache of pieces.

    A byte-level pre-tokenizer never crosses the border before a space that
    stands between two other characters than white space, and a line feed that
    stands so is a piece of its own. A text whose spaces and line feeds all
    stand so is encoded piece by piece, each distinct piece once; any other text
    goes to the library whole. New pieces are encoded end to end in one call:
    only a piece's first id starts with its space (or is the line feed put
    before it), which shows where each begins."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        before = self.tokenizer.pre_tokenizer
        self.by_pieces = (isinstance(before, ByteLevel) and not before.add_prefix_space
                          and self.tokenizer.normalizer is None)
        if self.by_pieces:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
            for token, i in vocabulary.items():
                self.spaced[i] = token.startswith("\u0120")
            self.line_feed = vocabulary["\u010a"]
            self.marks = {c: vocabulary[c] for c in ".,;:!?"}
        self._clear()

    def _clear(self) -> None:
        # Entry 0 is the empty piece, entry 1 the line feed.
        self.known: tuple[dict, dict] = ({"": 0}, {})
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)
        self.entries, self.used = 1, 0
        if self.by_pieces:
            self._add(np.array([self.line_feed], np.uint32), np.ones(1, np.int64))

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self.entries + len(sizes), self.used + len(ids)
        if n > len(self.ends):
            self.ends = np.resize(self.ends, 2 * n)
        if m > len(self.flat):
            self.flat = np.resize(self.flat, 2 * m)
        self.ends[self.entries:n] = self.used + np.cumsum(sizes)
        self.flat[self.used:m] = ids
        self.entries, self.used = n, m

    def _look_up(self, pieces: list[str], spaced: bool) -> np.ndarray:
        """Entry of each distinct piece, with or without a space before it."""
        known = self.known[spaced]
        new = [p for p in pieces if p not in known]
        # A mark after a letter is a piece of its own for the pre-tokenizer.
        marked = [p for p in new if p[-1] in self.marks and p[-2:-1].isalpha() and p[-2] < "\u0250"]
        if marked:
            bases = list(dict.fromkeys(p[:-1] for p in marked))
            at = dict(zip(bases, self._look_up(bases, spaced).tolist()))
            entry = np.fromiter((at[p[:-1]] for p in marked), np.int64, len(marked))
            starts = np.where(entry > 0, self.ends[entry - 1], 0)
            sizes = self.ends[entry] - starts + 1
            ids = np.empty(int(sizes.sum()), np.uint32)
            last = np.cumsum(sizes) - 1
            inner = np.ones(len(ids), bool)
            inner[last] = False
            ids[inner] = self.flat[ragged(starts, sizes - 1)]
            ids[last] = np.fromiter((self.marks[p[-1]] for p in marked), np.uint32, len(marked))
            known.update(zip(marked, range(self.entries, self.entries + len(marked))))
            self._add(ids, sizes)
            new = [p for p in new if p not in known]
        mark = " " if spaced else "\n"
        for i in range(0, len(new), CALL_PIECES):
            part = new[i:i + CALL_PIECES]
            got = self.tokenizer.encode_batch_fast([mark + mark.join(part)], add_special_tokens=False)
            ids = np.array(got[0].ids, np.uint32)
            first = np.nonzero(self.spaced[ids] if spaced else ids == self.line_feed)[0]
            if len(first) != len(part):
                raise AssertionError("pieces were not kept apart")
            sizes = np.diff(np.append(first, len(ids)))
            known.update(zip(part, range(self.entries, self.entries + len(part))))
            if not spaced:
                ids, sizes = np.delete(ids, first), sizes - 1
            self._add(ids, sizes)
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        words = lists.flatten().dictionary_encode()
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(counts) - counts
        index = words.indices.to_numpy(zero_copy_only=False)
        # No word holds a space, so one string carries them all out of Arrow.
        held = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
        names = pc.binary_join(held, " ")[0].as_py().split(" ")
        feed = index == (names.index("\n") if "\n" in names else -1)
        head = np.zeros(len(index), bool)
        head[begins] = True
        head[1:] |= feed[:-1]
        head &= ~feed
        plain = ~(head | feed)
        entry = np.zeros(len(names), np.int64)
        number = np.empty(len(index), np.int64)
        for spaced, where in ((True, plain), (False, head)):
            used = np.zeros(len(names), bool)
            used[index[where]] = True
            at = np.flatnonzero(used)
            entry[at] = self._look_up([names[i] for i in at.tolist()], spaced)
            number[where] = entry[index[where]]
        number[feed] = 1
        first = np.append(0, self.ends[:self.entries - 1])
        size = self.ends[:self.entries] - first
        lengths = size[number]
        return self.flat[ragged(first[number], lengths)], np.add.reduceat(lengths, begins)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each); no nulls."""
        if self.entries > CACHED_PIECES:
            self._clear()
        plain = np.zeros(len(texts), bool)
        if self.by_pieces:
            plain = ~pc.match_substring_regex(texts, _NOT_PLAIN).to_numpy(zero_copy_only=False)
            plain &= pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        sizes = np.zeros(len(texts), np.int64)
        parts: dict[bool, np.ndarray] = {}
        if plain.any():
            parts[True], sizes[plain] = self._by_pieces(texts.filter(pa.array(plain)))
        if not plain.all():
            rest = texts.filter(pa.array(~plain)).to_pylist()
            got = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            sizes[~plain] = np.fromiter(map(len, got), np.int64, len(got))
            parts[False] = np.fromiter((x for y in got for x in y), np.uint32, int(sizes[~plain].sum()))
        if len(parts) == 1:
            return next(iter(parts.values())), sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        mine = np.repeat(plain, sizes)
        for k, ids in parts.items():
            out[mine if k else ~mine] = ids
        return out, sizes


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all [start, start + length), end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    # Half as wide where it holds them: the indices are most of the memory that is moved.
    kind = np.int32 if total + int(starts.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def run_offsets(same: np.ndarray) -> np.ndarray:
    """How far each place lies from the start of its run; ``same`` marks places
    that go on with the run of the place before."""
    out = np.zeros(len(same), np.int64)
    own = np.flatnonzero(same)
    if len(own):
        # Places that go on with a run, numbered within each stretch of them.
        index = np.arange(len(own))
        begins = np.append(True, own[1:] != own[:-1] + 1)
        out[own] = index - np.maximum.accumulate(np.where(begins, index, 0)) + 1
    return out


_MIX = np.uint64(0xD6E8FEB86659FD93)


def frequent(pair: np.ndarray, spot: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each place's pair, pairs, counts) of the pairs that have at
    least ``least`` of the places ``spot``; other places get the number after
    the last. Counts are exact: a bucket of hashes below ``least`` only shows
    early that none of its pairs has as many."""
    own = np.flatnonzero(spot)
    bits = min(BUCKET_BITS, max(8, len(own).bit_length() + 1))
    bucket = ((pair[own].view(np.uint64) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
    own = own[np.bincount(bucket, minlength=1 << bits)[bucket] >= least]
    coded = pa.array(pair[own]).dictionary_encode()
    index, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    count = np.bincount(index, minlength=len(keys))
    often = count >= least
    none = int(often.sum())
    code = np.full(len(pair), none, np.int32)
    code[own] = np.where(often, np.cumsum(often) - 1, none).astype(np.int32)[index]
    return code, keys[often], count[often]


def compress(ids: np.ndarray, last: np.ndarray, base: int,
             least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last, rules) of a shard. ``last`` marks each document's last
    symbol; rule k of the (n, 2) array is nonterminal base + k. Each round
    counts all pairs exactly and replaces those that occur ``least`` times,
    the more frequent first, until none does. A pair below that count stays
    below it, so later rounds look only at the places of the others and of
    pairs with a new symbol (``open_``)."""
    syms, last, rules = ids.astype(np.int32), last.copy(), []
    next_id = base
    open_ = np.ones(max(0, len(syms) - 1), bool)
    while True:
        # Of a run of one symbol every second place counts, as neighbours there share a symbol.
        at = np.flatnonzero(open_ & ~last[:-1])
        pair = (syms[at].astype(np.int64) << 32) | syms[at + 1]
        again = np.zeros(len(at), bool)
        again[1:] = (at[1:] == at[:-1] + 1) & (pair[1:] == pair[:-1])
        spot = run_offsets(again) % 2 == 0
        code, keys, count = frequent(pair, spot, least)
        none = len(keys)
        if not none:
            break
        # Pairs of like frequency go in scrambled order, or along a chain of
        # them only the first pair would be replaced in a round.
        order = np.lexsort((keys.view(np.uint64) * _MIX, -np.log2(count).astype(np.int64)))
        place = np.full(none + 1, none, np.int32)
        place[order] = np.arange(none)
        # Turn of every place; inside a run the places between the counted ones have it too.
        turn = place[code]
        between = np.flatnonzero(~spot)
        turn[between] = turn[between - 1]
        some = np.flatnonzero(turn < none)
        at, turn = at[some], turn[some]
        open_[:] = False
        open_[at] = True
        # A run goes when its neighbours come later; of its places every second,
        # and where the one before comes sooner, from the second place on.
        beside, again, late = (np.zeros(len(at), bool) for _ in range(3))
        beside[1:] = at[1:] == at[:-1] + 1
        again[1:] = beside[1:] & (turn[1:] == turn[:-1])
        late[1:] = beside[1:] & (turn[:-1] < turn[1:])
        offset = run_offsets(again)
        wait, inner = late.copy(), np.flatnonzero(again)
        wait[inner] = late[inner - offset[inner]]
        take = ~late
        take[inner] = (offset[inner] - wait[inner]) % 2 == 0
        take[:-1] &= ~beside[1:] | (turn[:-1] <= turn[1:])
        # A pair left with fewer places than that waits; the first in turn never does.
        taken = np.bincount(turn[take], minlength=none)
        used = np.flatnonzero(taken >= least)
        number = np.zeros(none, np.int32)
        number[used] = next_id + np.arange(len(used))
        take &= taken[turn] >= least
        some = np.flatnonzero(take)
        at, turn = at[some], turn[some]
        syms[at] = number[turn]
        last[at] = last[at + 1]
        stay = np.ones(len(syms), bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        fresh = np.zeros(len(syms), bool)
        fresh[at] = True
        open_ = np.append(open_, False)[stay][:-1]
        fresh, syms, last = fresh[stay], syms[stay], last[stay]
        open_ |= fresh[:-1] | fresh[1:]
        pairs = keys[order[used]]
        rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1))
        next_id += len(used)
    return syms, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def levels(rules: np.ndarray, base: int):
    """(first, stop) of successive stretches of rules that use none of their own stretch."""
    needs = np.maximum.accumulate(rules.max(axis=1) - base) if len(rules) else np.zeros(0, np.int64)
    first = 0
    while first < len(rules):
        stop = int(np.searchsorted(needs, first, "left"))
        yield first, stop
        first = stop


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each nonterminal expands to; a rule only uses earlier ones."""
    out = np.zeros(len(rules), np.int64)
    for first, stop in levels(rules, base):
        part = rules[first:stop]
        out[first:stop] = np.where(part < base, 1, out[np.maximum(part - base, 0)]).sum(axis=1)
    return out


_ARRAYS = (("doc_ids", "<i8"), ("doc_null", "u1"), ("doc_symbols", "<i8"), ("doc_ids_before", "<i8"),
           ("rules", "<i4"), ("lengths", "<i4"), ("low", "<u2"), ("high", "u1"))


def write_shard(folder: str, stem: str, doc_ids: list, ids: np.ndarray, sizes: np.ndarray, base: int) -> str:
    last = np.zeros(len(ids), bool)
    last[np.cumsum(sizes) - 1] = True
    syms, last, rules = compress(ids, last, base)
    ends = np.nonzero(last)[0] + 1
    wide = max(1, int(syms.max(initial=0)).bit_length()) - 16
    planes = [np.packbits((syms >> (16 + b)) & 1) for b in range(max(0, wide))]
    arrays = {
        "doc_ids": np.array([d or 0 for d in doc_ids], np.int64),
        "doc_null": np.array([d is None for d in doc_ids], np.uint8),
        "doc_symbols": np.concatenate([[0], ends]), "doc_ids_before": np.concatenate([[0], np.cumsum(sizes)]),
        "rules": rules.reshape(-1), "lengths": rule_lengths(rules, base), "low": syms & 0xFFFF,
        "high": np.concatenate(planes) if planes else np.zeros(0, np.uint8)}
    counts = np.array([len(arrays[n]) for n, _ in _ARRAYS] + [base], np.int64)
    uri, out = new_file(folder, stem, ".rp")
    with out:
        out.write(MAGIC + counts.astype("<i8").tobytes())
        for name, kind in _ARRAYS:
            out.write(arrays[name].astype(kind).tobytes())
    return uri


class Shard:
    """A shard file; documents and spans are decoded on demand."""

    def __init__(self, uri: str):
        with open_file(uri) as f:
            if f.read(8) != MAGIC:
                raise ValueError(f"not a token shard: {uri}")
            *counts, self.base = np.frombuffer(f.read(8 * (len(_ARRAYS) + 1)), "<i8").tolist()
            own = {n: np.frombuffer(f.read(c * np.dtype(k).itemsize), k) for (n, k), c in zip(_ARRAYS, counts)}
        self.doc_ids = [None if null else d for d, null in zip(own["doc_ids"].tolist(), own["doc_null"].tolist())]
        self.doc_symbols, self.before = own["doc_symbols"], own["doc_ids_before"]
        self.low, self.n = own["low"], len(own["low"])
        step = (self.n + 7) // 8
        self.planes = [own["high"][i:i + step] for i in range(0, len(own["high"]), step)] if step else []
        rules, lengths = own["rules"].reshape(-1, 2).astype(np.int64), own["lengths"].astype(np.int64)
        # Expansions of all symbols in one array: the ids themselves, then each rule's ids.
        self.length = np.concatenate([np.ones(self.base, np.int64), lengths])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.arange(self.base + int(lengths.sum()), dtype=np.uint32)
        for i, j in levels(rules, self.base):
            own = rules[i:j].reshape(-1)
            s = int(self.start[self.base + i])
            part = ragged(self.start[own], self.length[own])
            self.flat[s:s + len(part)] = self.flat[part]

    def symbols(self, first: int, stop: int) -> np.ndarray:
        out = self.low[first:stop].astype(np.int64)
        lead = first % 8
        for b, plane in enumerate(self.planes):
            bits = np.unpackbits(plane[first // 8:(stop + 7) // 8])[lead:lead + stop - first]
            out |= bits.astype(np.int64) << (16 + b)
        return out

    def documents(self, first: int, stop: int) -> np.ndarray:
        """All ids of the documents [first, stop), end to end."""
        s = self.symbols(int(self.doc_symbols[first]), int(self.doc_symbols[stop]))
        return self.flat[ragged(self.start[s], self.length[s])]

    def span(self, doc: int, first: int, stop: int) -> np.ndarray:
        """Ids [first, stop) of one document; only the symbols that hold them are expanded."""
        s = self.symbols(int(self.doc_symbols[doc]), int(self.doc_symbols[doc + 1]))
        ends = np.cumsum(self.length[s])
        i, j = np.searchsorted(ends, first, "right"), np.searchsorted(ends, stop, "left") + 1
        s = s[i:j]
        skip = first - (int(ends[i - 1]) if i else 0)
        return self.flat[ragged(self.start[s], self.length[s])][skip:skip + stop - first]


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          folder: str | None = None) -> DataFrame:
    """Write the shards; the stored manifest has (part, seq, path, n_ids), in
    document order by (part, seq). ``tokenizer`` names a file of public_tokenizers."""
    spark = docs.sparkSession
    folder = qualified(spark, folder or run_dir(spark, "tokens"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, total // PARTITION_BYTES))
    # Rows of one id in a defined order, so that a repeated attempt writes the same.
    ordered = (own.repartitionByRange(parts, "id", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
               .sortWithinPartitions("part", "id", F.xxhash64("text")))

    def run(batches):
        import public_tokenizers

        enc = encoder(public_tokenizers.path(tokenizer))
        base = enc.tokenizer.get_vocab_size(with_added_tokens=True)
        held, seq, part = [], 0, 0

        def flush():
            nonlocal held, seq
            sizes = np.concatenate([s for _, _, s in held])
            ids = np.concatenate([i for _, i, _ in held])
            path = write_shard(folder, f"part-{part:06d}-{seq:05d}", [d for x, _, _ in held for d in x], ids, sizes, base)
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([path]),
                                   pa.array([len(ids)], pa.int64())], names=["part", "seq", "path", "n_ids"])
            held, seq = [], seq + 1
            return row

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            size = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.unique(np.append(np.searchsorted(size, np.arange(_CHUNK_BYTES, size[-1], _CHUNK_BYTES)) + 1, b.num_rows))
            for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                ids, sizes = enc.encode(b.column("text").slice(i, j - i))
                full = np.zeros(len(ids) + len(sizes), np.uint32)
                ended = np.cumsum(sizes + 1) - 1
                inner = np.ones(len(full), bool)
                inner[ended] = False
                full[inner], full[ended] = ids, END_ID
                held.append((b.column("id").slice(i, j - i).to_pylist(), full, sizes + 1))
                pa.default_memory_pool().release_unused()
                if sum(len(x) for _, x, _ in held) >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()

    return stored(ordered.select("id", "text", "part").mapInArrow(
        run, "part int, seq int, path string, n_ids long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(id, start, n_ids, ids_crc32) of every document, decoded from the shards."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = manifest.withColumn("inner", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = inside.join(before, "part").select("path", (F.col("before") + F.col("inner")).alias("begin"))

    def run(batches):
        for b in batches:
            for path, begin in zip(b.column("path").to_pylist(), b.column("begin").to_pylist()):
                shard = Shard(path)
                n = len(shard.doc_ids)
                ids = shard.documents(0, n).astype("<u4")
                cut = shard.before.tolist()
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(cut, cut[1:])]
                yield pa.record_batch(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(begin + shard.before[:-1]),
                     pa.array(np.diff(shard.before)), pa.array(crc, pa.int64())],
                    names=["id", "start", "n_ids", "ids_crc32"])

    wide = max(1, manifest.count())
    return starts.repartition(min(wide, 20_000), "path").mapInArrow(
        run, "id long, start long, n_ids long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encode every whole text, write the shards, read them back: one row per
    input row with id, start, n_ids (end id included) and ids_crc32.

    Nulls: a null text counts as empty (the end id alone); null ids come first.
    Rows of one id keep a fixed order by text; rows that repeat wholly are
    written as often as they come. Other columns are ignored. An empty table
    writes no shard.
    """
    return read(write(docs, tokenizer, id_col, text_col))
