"""Small document tables for the operators' tests, and plain versions of shared rules."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars int"
# Columns of other tables and of the operators' own working tables.
CLASHING = "k1 long, fp string, n_words string, n_bytes string, kept string, shard string, _doc string, _text string, id string"


def lower_ascii(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text))


def prose(rng: random.Random, n: int) -> str:
    syllables = ["ta", "ré", "mo", "Ñi", "sü", "lor", "en", "pa", "qui", "ver", "za", "do"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
                    + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n)).replace("\n ", "\n")


def texts(seed: int = 5) -> list[str | None]:
    """Nulls, empty and blank texts, exact and near copies, shared passages, a long text."""
    rng = random.Random(seed)
    out: list[str | None] = [None, None, "", "", "   ", "a", "A", "é", "one two", "x" * 900, "\n\n", "…"]
    base = [prose(rng, rng.randrange(30, 160)) for _ in range(14)]
    passage = prose(rng, 110)
    out += base + base[:3] * 2
    for text in base[:6]:
        own = text.split(" ")
        own[len(own) // 2] = "changed"
        out.append(" ".join(own))
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 15)}" for _ in range(6)]
    out.append(prose(rng, 9000))
    return out


def documents(spark, values=None, schema: str = DOCS):
    values = texts() if values is None else values
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t) if t is not None else None)
                                  for i, t in enumerate(values)], schema)


def with_clashes(df):
    """The same rows with more columns, named as other tables' or working columns are."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0])
                            for c in CLASHING.split(", ")])


def repeated(df):
    """Every row twice, and rows without id."""
    from pyspark.sql import functions as F

    return df.union(df).union(df.withColumn("doc_id", F.lit(None).cast("long")))


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()),
                  key=lambda t: tuple((x is None, str(type(x)), x) for x in t))


def components(n: int, linked) -> list[int]:
    """Smallest index reachable from each, over pairs i > j with linked(i, j)."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
