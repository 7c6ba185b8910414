import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from llm import small
from tidemark.llm import prefix_trie

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn int, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [t[2] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])     # the remainder has the id's sign
    return out


def plain(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    saved = {p: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    leaves = {p: 0 if p in children else 1 for p in members}
    for p in sorted(members, key=len, reverse=True):
        if p:
            saved[p[:-1]] += saved[p]
            leaves[p[:-1]] += leaves[p]
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p],
         sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items())


def got(df, **more):
    return sorted(tuple(r[c] for c in COLS) for r in prefix_trie.trie(df, **more).collect())


def conversations(seed, n=150):
    rng = random.Random(seed)
    turns = ["Hello  there", "how are\tyou", "", None, "é ü", "fine\n\nthanks", "bye"]
    rows = []
    for c in rng.sample(range(-30, 400), n):
        for k in range(rng.randrange(1, 9)):
            rows.append((c, k, rng.choice(["user", "assistant", None]) if k else "user",
                         "common" if k == 0 and rng.random() < 0.6 else rng.choice(turns)))
    return rows


@pytest.mark.parametrize("limits", [{}, {"band": 4, "shard_rows": 10, "chunk": 2}])
def test_against_brute_force(spark, limits):
    rows = conversations(7)
    rows += [(1000 + i, k, "user", "the same") for i in range(200) for k in range(5)]      # one very common conversation
    rows += [(2000, k, "user", f"turn {k % 3}") for k in range(11)]                        # a long one and its relatives
    rows += [(2001, k, "user", f"turn {k % 3}" if k < 9 else "other") for k in range(11)]
    random.Random(1).shuffle(rows)
    assert got(spark.createDataFrame(rows, SCHEMA), **limits) == plain(rows)


def test_turnless_conversations(spark):
    """Conversations that lose all own turns to an absent base end at the root."""
    gone = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:5]
    rows = [(c, 0, "user", "only") for c in gone]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert len(plain(rows)) == 1


def test_nulls_ties_repeats_clashes_and_empty(spark):
    rows = conversations(3, 40)
    rows += [(c, None, r, t) for c, k, r, t in rows if k == 1] + [(None, 0, "user", "no conversation")]
    rows += [(c, k, "user", "tie") for c, k, r, t in rows if k == 2] + rows[:30]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(small.with_clashes(df)) == plain(rows)
    assert got(df.limit(0)) == []
    assert got(df.where("conv_id IS NULL")) == []


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 300_000), (2, 0, "user", "word " * 300_000), (2, 1, "user", "x")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_a_shared_digest_is_found(spark, monkeypatch):
    """With a first seed whose digests all agree, the nodes are not sound and another seed is taken."""
    rows = conversations(5, 30)
    seeds, original = [], prefix_trie.with_prefixes

    def poor(turns, seed, chunk):
        from pyspark.sql import functions as F

        seeds.append(seed)
        good = original(turns, seed, chunk)
        if seed > 42:
            return good
        return good.withColumns({k: F.col("depth") for k in "abcd"}).withColumns({f"p{k}": F.col("depth") - 1 for k in "abcd"})

    monkeypatch.setattr(prefix_trie, "with_prefixes", poor)
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert seeds == [42, 44]


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 32, (20_000, 5)), axis=0)
    table = prefix_trie.Slots(keys)
    slots = table.find(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    other = keys.copy()
    other[:, 2] ^= 1
    known = {tuple(k) for k in keys.tolist()}
    assert all(s == -1 for s, k in zip(table.find(other).tolist(), other.tolist()) if tuple(k) not in known)
    assert len(prefix_trie.Slots(keys[:0]).find(keys[:3])) == 3 and (prefix_trie.Slots(keys[:0]).find(keys[:3]) == -1).all()
    # Equal keys have no slots of their own: they must be told apart before.
    single = prefix_trie.Slots(keys[:1])
    assert single.find(keys[:2]).tolist() == [0, -1]
