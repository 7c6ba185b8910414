import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from llm import small
from tidemark.llm import token_files

NAME = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def encoder():
    return token_files.encoder(public_tokenizers.path(NAME))


def test_encoder_equals_the_library(encoder):
    rng = random.Random(3)
    parts = ["a", "B", "é", "ß", "中", "1", ".", " ", "\n", "'s", "'", "  ", "\t", " ", "　", "\r\n", "\x1c",
             "\x85", "🙂", "\x00", "<|endoftext|>", "the", " of", "\n\n", "word"]
    values = ["", "\n", " ", "\nabc", "abc\n", "a\nb", "it's 's 1a"]
    values += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    values += [t for t in small.texts() if t]
    ids, sizes = encoder.encode(pa.array(values))
    want = [e.ids for e in encoder.tokenizer.encode_batch(values, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want))
    assert ids.tolist() == [x for y in want for x in y]


def test_grammar_round_trip_and_random_access(tmp_path):
    rng = np.random.default_rng(1)
    phrase = rng.integers(0, 300, 40)
    docs = [np.concatenate([phrase[:rng.integers(1, 40)] for _ in range(rng.integers(1, 30))] + [np.zeros(1, int)])
            for _ in range(40)] + [np.zeros(1, int), np.full(500, 7)]
    sizes = np.array([len(d) for d in docs])
    ids = np.concatenate(docs).astype(np.uint32)
    path = token_files.write_shard(str(tmp_path), "s", list(range(41)) + [None], ids, sizes, 50257)
    shard = token_files.Shard(path)
    assert shard.n < len(ids) / 2 and len(shard.length) > 50257
    assert (shard.documents(0, 42) == ids).all()
    assert shard.doc_ids[-2:] == [40, None]
    for i, d in enumerate(docs):
        assert (shard.documents(i, i + 1) == d).all()
        a = int(rng.integers(0, len(d)))
        b = int(rng.integers(a, len(d))) + 1
        assert (shard.span(i, a, b) == d[a:b]).all()


def plain(encoder, values):
    start, out = 0, []
    for i, t in enumerate(values):
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, encoder, monkeypatch):
    monkeypatch.setattr(token_files, "PARTITION_BYTES", 20_000)
    values = small.texts()
    got = token_files.round_trip(small.with_clashes(small.documents(spark)).withColumnRenamed("id", "doc"))
    assert small.rows(got, "id", "start", "n_ids", "ids_crc32") == plain(encoder, values)


def test_repeats_null_ids_and_empty(spark):
    df = small.repeated(small.documents(spark, ["b c", None]))
    got = small.rows(token_files.round_trip(df), "id", "n_ids", "start")
    assert [(i, n) for i, n, _ in got] == [(0, 3), (0, 3), (1, 1), (1, 1), (None, 1), (None, 3)]
    assert sorted(s for _, _, s in got)[0] == 0
    assert token_files.round_trip(df.limit(0)).count() == 0


def pair_counts(syms, last):
    """Places of each pair that share no symbol."""
    out: dict = {}
    before = None
    for a, b, ends in zip(syms, syms[1:], last):
        pair = None if ends or (a, b) == before else (a, b)
        if pair:
            out[pair] = out.get(pair, 0) + 1
        before = pair
    return out


def compressed(ids, last, least=2):
    syms, last, rules = token_files.compress(np.array(ids, np.uint32), np.array(last), 1000, least)
    whole = [[i] for i in range(1000)]
    for a, b in rules.tolist():
        whole.append(whole[a] + whole[b])
    assert [x for s in syms.tolist() for x in whole[s]] == list(ids)
    assert token_files.rule_lengths(rules, 1000).tolist() == [len(w) for w in whole[1000:]]
    return syms.tolist(), last.tolist()


@pytest.mark.parametrize("least", [2, 3, token_files.LEAST_COUNT])
def test_no_frequent_pair_is_left(least):
    rng = np.random.default_rng(5)
    for _ in range(150):
        n = int(rng.integers(1, 300))
        last = rng.random(n) < rng.choice([0, 0.02, 0.3])
        last[-1] = True
        syms, last = compressed(rng.integers(0, rng.integers(1, 12), n).tolist(), last, least)
        assert max(pair_counts(syms, last).values(), default=0) < least


def test_copies_of_a_long_text_and_runs_become_few_symbols():
    rng = np.random.default_rng(6)
    text = rng.permutation(900).tolist()
    last = np.zeros(900 * 300, bool)
    last[899::900] = True
    assert len(compressed(text * 300, last)[0]) == 300
    alone = np.zeros(500, bool)
    alone[-1] = True
    assert len(compressed([7] * 500, alone)[0]) < 10


def test_least_count_saves_bytes(tmp_path):
    """Files are smallest near the least count that the storage cost gives."""
    rng = np.random.default_rng(8)
    ids = (rng.zipf(1.3, 200_000) % 5000).astype(np.uint32)
    size = {}
    for least in (2, token_files.LEAST_COUNT, 60):
        syms, _, rules = token_files.compress(ids, np.arange(len(ids)) == len(ids) - 1, 50257, least)
        size[least] = len(syms) * 18 / 8 + 12 * len(rules)
    assert size[token_files.LEAST_COUNT] < min(size[2], size[60])


def test_run_offsets_of_any_mask():
    rng = np.random.default_rng(11)
    for same in [np.zeros(0, bool), np.zeros(5, bool), *[np.append(False, rng.random(40) < p) for p in (0.1, 0.5, 0.95)]]:
        plain, run = [], 0
        for x in same.tolist():
            run = run + 1 if x else 0
            plain.append(run)
        assert token_files.run_offsets(same).tolist() == plain


def test_hash_buckets_stay_small_and_counts_exact(monkeypatch):
    """More places than buckets: collisions only let a rare pair through to the exact count."""
    sizes, plain = [], np.bincount
    monkeypatch.setattr(token_files.np, "bincount", lambda x, minlength=0: sizes.append(minlength) or plain(x, minlength=minlength))
    pair = np.random.default_rng(12).integers(0, 1 << 19, 1 << 21)
    code, keys, count = token_files.frequent(pair, np.ones(len(pair), bool), 8)
    monkeypatch.undo()
    assert max(sizes) <= 1 << 20
    values, held = np.unique(pair, return_counts=True)
    assert dict(zip(keys.tolist(), count.tolist())) == dict(zip(values[held >= 8].tolist(), held[held >= 8].tolist()))
    assert (np.append(keys, -1)[code] == np.where(held[np.searchsorted(values, pair)] >= 8, pair, -1)).all()


def test_pieces_go_to_the_library_in_small_calls():
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.most = tokenizer, 0

        def encode_batch_fast(self, texts, **options):
            self.most = max(self.most, *(len(x.split()) for x in texts))
            return self.tokenizer.encode_batch_fast(texts, **options)

    enc = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer, enc.tokenizer = enc.tokenizer, Counted(enc.tokenizer)
    text = " ".join(f"w{i:x}y{i % 7}" for i in range(1500))
    ids, sizes = enc.encode(pa.array([text]))
    assert 0 < enc.tokenizer.most <= 200
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]
