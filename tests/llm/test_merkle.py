import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from llm import small
from tidemark.llm import merkle


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    return h(*[field(v) for v in (doc, source, lang, n, text)])


def tree(nodes):
    """All levels of a plain tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h(*row[i:i + 3]) for i in range(0, len(row), 3)])
    return levels


def runs(levels, at):
    """(siblings left, siblings right) from a leaf upwards."""
    out = []
    for row in levels[:-1]:
        first = at - at % 3
        run = row[first:first + 3]
        out.append((run[:at - first], run[at - first + 1:]))
        at //= 3
    return out


def plain(rows, shown=lambda doc, text: text):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = (own, tree([leaf(*r) for r in own]))
    upper = tree([trees[s][1][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        own, levels = trees[s]
        for i, r in enumerate(own):
            steps = runs(levels, i) + runs(upper, k)
            node = leaf(*r[:4], shown(r[0], r[4]))
            for left, right in steps:
                node = h(*left, node, *right)
            root = upper[-1][0]
            out.append((r[0], leaf(*r), levels[-1][0], root, h(*[d for a, b in steps for d in a + b]), node, node == root))
    return sorted(out, key=lambda t: (t[0] is not None, t))


COLS = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SHOWN = "CASE WHEN crc32(CAST(doc_id AS STRING)) % 2 = 0 THEN replace(text, '\n', '') ELSE text END"


def tampered(doc, text):
    if doc is None or text is None or zlib.crc32(str(doc).encode()) % 2:
        return text
    return text.replace("\n", "")


def got(df, **more):
    return sorted([tuple(r[c] for c in COLS) for r in merkle.manifest(df, **more).collect()],
                  key=lambda t: (t[0] is not None, t))


@pytest.mark.parametrize("height", [1, 2, 6])
def test_against_a_plain_tree(spark, height):
    rng = random.Random(height)
    values = small.texts()
    rows = []
    for i in range(120):
        # One source has most rows; one has a single row; one is null, one empty.
        source = rng.choice(["hot"] * 6 + ["b", "é", "", None]) if i else "alone"
        rows.append((i, source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice(values)))
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    expected = plain(rows, tampered)
    assert got(small.with_clashes(df), presented=F.expr(SHOWN), height=height) == expected
    assert any(not r[-1] for r in expected) and any(r[-1] for r in expected)


def test_every_size_of_a_source(spark):
    rows = [(i, f"s{n:02d}", "en", 1, f"text {i}") for n in range(1, 12) for i in range(n * 100, n * 100 + n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    assert got(df, height=1) == plain(rows)
    assert all(r[-1] for r in got(df, height=2))


def test_null_ids_repeats_and_empty(spark):
    df = small.documents(spark, ["a", None, "b\n", ""])
    df = small.repeated(df)
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(df, presented=F.expr(SHOWN), height=1) == plain(rows, tampered)
    assert merkle.manifest(df.limit(0)).collect() == []
    one = df.limit(1)
    only = merkle.manifest(one).first()
    assert only["leaf"] == only["subroot"] == only["root"] and only["proof_sha256"] == h() and only["verified"]


@pytest.mark.parametrize("height", range(7))
def test_addresses_are_a_permutation_in_van_emde_boas_order(height):
    flat = [a for level in merkle.addresses(height) for a in level]
    assert sorted(flat) == list(range(merkle.slots(height)))
    assert merkle.address(height, 0, 0) == 0
    if height > 1:
        # Each bottom tree is one stretch, and the stretches follow each other.
        top = (height - 1) // 2
        below = height - top - 1
        for i in range(3 ** (top + 1)):
            own = [merkle.address(height, top + 1 + d, i * 3 ** d + j) for d in range(below + 1) for j in range(3 ** d)]
            first = merkle.slots(top) + i * merkle.slots(below)
            assert sorted(own) == list(range(first, first + merkle.slots(below)))


def test_block_agrees_with_a_plain_tree():
    for n in (1, 2, 3, 4, 9, 10, 26, 27):
        leaves = [sha256(str(i).encode()).digest() for i in range(n)]
        tall = merkle.levels_of(n)
        block = merkle.Block.build(leaves, tall)
        levels = tree([d.hex() for d in leaves])
        assert block.root.hex() == levels[-1][0]
        for i in range(n):
            assert merkle.fold(leaves[i], block.path(i)) == block.root
            assert merkle.proof(block.path(i)).decode() == "".join(d for a, b in runs(levels, i) for d in a + b)
