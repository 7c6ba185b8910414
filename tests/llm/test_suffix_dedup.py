import hashlib
import random
from collections import Counter

import pytest

from llm import small
from tidemark.llm import suffix_dedup


def plain(values, length):
    count = Counter()
    raw = [(t or "").encode() for t in values]
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] += 1
    out = []
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def spliced(seed=9):
    """Texts that share passages of just under and over the length, at any offset."""
    rng = random.Random(seed)
    source = small.prose(rng, 900)
    out = small.texts()
    for size in (398, 399, 400, 401, 420, 700, 1500):
        for _ in range(3):
            at = rng.randrange(len(source) - size)
            out.append(small.prose(rng, rng.randrange(0, 60)) + source[at:at + size] + small.prose(rng, rng.randrange(0, 60)))
    return [*out, source, "ab" * 700, "z" * 399, "z" * 401]


@pytest.mark.parametrize("together", [suffix_dedup.TOGETHER, 1])
def test_against_brute_force(spark, monkeypatch, together):
    """Ranks of few and (with the bound at 1) of many blocks."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    values = spliced()
    df = small.with_clashes(small.documents(spark, values)).drop("n_bytes")
    got = suffix_dedup.remove_repeats(df, keep=["doc_id"])
    assert small.rows(got, *COLUMNS) == plain(values, 400)


def test_long_texts_come_in_segments():
    """Runs of a text cut into segments cover the same windows."""
    text = small.prose(random.Random(4), 3000).encode()
    whole = [(low, n) for *_, lows, ns, _, _ in suffix_dedup._each_run([text], 400) for low, n in zip(lows, ns)]
    old, suffix_dedup.SEGMENT = suffix_dedup.SEGMENT, 1000
    try:
        cut = [(low, n) for *_, lows, ns, _, _ in suffix_dedup._each_run([text], 400) for low, n in zip(lows, ns)]
    finally:
        suffix_dedup.SEGMENT = old
    cover = lambda runs: sorted(w for low, n in runs for w in range(low, low + n))
    assert cover(whole) == cover(cut) == list(range(len(text) - 399))


def test_copies_repeats_and_empty(spark):
    df = small.repeated(small.documents(spark, ["y" * 50 + small.prose(random.Random(1), 90), None, ""]))
    got = suffix_dedup.remove_repeats(df)
    assert {(r.n_removed == r.n_bytes) for r in got.where("n_bytes >= 400").collect()} == {True}
    assert got.where("n_bytes < 400").agg({"n_removed": "sum"}).first()[0] == 0
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_cut_repeats_keeps_rows_and_columns(spark):
    values = spliced()
    df = small.with_clashes(small.documents(spark, values))
    cut = suffix_dedup.cut_repeats(df, chars_col="n_chars")
    assert cut.columns == df.columns
    removed = {i: n for i, _, n, _, _ in plain(values, 400)}
    for r in cut.select("doc_id", "text", "n_chars").collect():
        own = values[r.doc_id]
        if removed[r.doc_id] == 0:
            assert r.text == own
        else:
            lost = len(own.encode()) - removed[r.doc_id] - len(r.text.encode())
            assert 0 <= lost <= 8 and r.n_chars == len(r.text)
