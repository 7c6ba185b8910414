"""License notices by an exact set-similarity join.

Text blocks are all windows of BLOCK consecutive words, one from every word on
(a shorter text is one block). A block matches a template if it holds at least
the template's share of its distinct words, and among them those that name the
licence (the template's ``must``). Words are ordered by how many
documents of the whole corpus have them, rarest first. A matching block holds
one of the template's first |T| - need + 1 words in that order (prefix filter),
so an inverted index of those few rare words proposes all pairs of a template
and a stretch of blocks; stretches with fewer than need of the template's words
are pruned (length filter), and in the others the overlap of every block is
counted in one sweep over the places where it changes. The index holds the
templates only, a bounded parameter, and goes to every task; documents are
never shuffled. Phrases are templates that need all their words, and their
places are then read off the words.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import word_bytes

BLOCK = 64
STRIDE = 1               # a block starts at every word
THRESHOLD = 0.8
ALL_WORDS_UP_TO = 0      # no notice is too short for the threshold

# Phrases of the base labels, and notices of the scan's own labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
# The last words of each notice are those without which it names no licence.
NOTICES = (
    ("released under the mit license", "mit", "mit"),
    ("licensed under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files", "mit", "permission charge software"),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "bsd", "redistribution binary"),
    ("this program is free software you can redistribute it and or modify it under the terms of the "
     "gnu general public license as published by the free software foundation", "gpl-notice", "gnu license"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", "mozilla"),
    ("permission to use copy modify and or distribute this software for any purpose with or without "
     "fee is hereby granted", "isc", "permission fee software"),
    ("licensed under cc by nc", "cc-by-nc", "cc nc"),
    ("licensed under cc by sa", "cc-by-sa", "cc sa"),
    ("dedicated to the public domain", "public-domain", "public domain"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple          # in text order
    phrase: bool
    must: frozenset       # a matching block holds all of these


def templates(phrases=PHRASES, notices=NOTICES) -> list[Template]:
    own = [(t, label, True, t) for t, label in phrases] + [(t, label, False, must) for t, label, must in notices]
    return [Template(label, tuple(word_bytes(t)), base, frozenset(word_bytes(must)))
            for t, label, base, must in own if word_bytes(t)]


class Index:
    """Templates under the global word order, and their prefix words."""

    def __init__(self, own: list[Template], documents_with: dict, threshold: float = THRESHOLD):
        vocabulary = sorted({w for t in own for w in t.words}, key=lambda w: (documents_with.get(w, 0), w))
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.templates, self.needs, self.sets, self.prefix = own, [], [], defaultdict(list)
        for k, t in enumerate(own):
            ordered = sorted(set(t.words), key=self.place.__getitem__)
            need = len(ordered) if t.phrase else ceil(threshold * len(ordered))
            self.needs.append(need)
            self.sets.append(frozenset(ordered))
            for w in ordered[:len(ordered) - need + 1]:
                self.prefix[w].append(k)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first block start, end of the starts, containment) of all
        runs of blocks that match a template with the same containment."""
        rare = self.prefix.keys() & words
        if not rare:
            return []
        proposed = sorted({k for w in rare for k in self.prefix[w]})
        wanted = set().union(*(self.sets[k] for k in proposed))
        spots = defaultdict(list)
        for at, w in enumerate(words):
            if w in wanted:
                spots[w].append(at)
        last = max(0, len(words) - BLOCK)
        found = []
        for k in proposed:
            own, need, must = self.sets[k], self.needs[k], self.templates[k].must
            if len(own & spots.keys()) < need or not must <= spots.keys():
                continue
            heads = sorted(at for w in rare if k in self.prefix[w] for at in spots[w])
            for low, high in stretches(heads, last):
                here = []
                for w in own & spots.keys():
                    at = spots[w]
                    if part := at[bisect_left(at, low):bisect_right(at, high + BLOCK - 1)]:
                        here.append((w in must, part))
                if len(here) < need or sum(named for named, _ in here) < len(must):
                    continue
                # A word is counted in a block by its first place there.
                change, musts = Counter(), Counter()
                for named, part in here:
                    before = low - 1
                    for at in part:
                        start, stop = max(before + 1, at - BLOCK + 1), min(at, high) + 1
                        if start < stop:
                            change[start] += 1
                            change[stop] -= 1
                            musts[start] += named
                            musts[stop] -= named
                        before = at
                overlap, names, edges = 0, 0, sorted(change)
                for start, stop in zip(edges, edges[1:]):
                    overlap += change[start]
                    names += musts[start]
                    if overlap >= need and names == len(must):
                        found.append((k, start, stop, overlap / len(own)))
        return found


def stretches(heads: list[int], last: int) -> list[tuple[int, int]]:
    """First and last starts of the blocks that hold one of the places, joined where they meet."""
    out: list = []
    for at in heads:
        low, high = max(0, at - BLOCK + 1), min(at, last)
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def union_size(runs: list[tuple[int, int]]) -> int:
    """How many integers lie in any of the half-open runs."""
    n, end = 0, 0
    for start, stop in sorted(runs):
        n += max(0, stop - max(start, end))
        end = max(end, stop)
    return n


def places(words: list[bytes], phrase: tuple) -> list[int]:
    """Every start at which the phrase's words stand consecutively."""
    n, out, at = len(phrase), [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if tuple(words[at:at + n]) == phrase:
            out.append(at)


def scan_words(words: list[bytes], index: Index) -> tuple:
    """(n_base, first place, last place, base labels, all labels, score, matching blocks)."""
    found = index.matches(words)
    starts, base, labels, score = [], set(), set(), 0.0
    for k in sorted({k for k, *_ in found}):
        t = index.templates[k]
        if t.phrase:
            if at := places(words, t.words):
                starts += at
                base.add(t.label)
                score = 1.0
        else:
            labels.add(t.label)
            score = max(score, max(c for m, _, _, c in found if m == k))
    return (len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), score, union_size([(a, b) for _, a, b, _ in found]))


def documents_with(docs: DataFrame, vocabulary: set, text_col: str = "text") -> dict:
    """In how many documents each word of the vocabulary stands, over all documents."""
    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(vocabulary.intersection(word_bytes(t)))
        yield pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())],
                              names=["word", "n"])

    each = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r.word): r.n for r in each.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_words, n_base (places of base phrases),
    first_word and last_word (smallest and largest place, else null),
    base_labels and labels (distinct, sorted, comma-joined), score (greatest
    containment found, 1 for a base phrase, else 0) and n_blocks (matching
    blocks).

    Nulls: a null text is empty; ids pass through, null too. Equal texts and
    repeated rows get equal results. Whole texts of any length are read. Other
    columns are ignored. An empty table gives an empty result.
    """
    own = templates(phrases, notices)
    vocabulary = {w for t in own for w in t.words}
    index = Index(own, documents_with(docs, vocabulary, text_col), threshold)

    def run(batches):
        for b in batches:
            words = (word_bytes(t) for t in b.column("text").to_pylist())
            rows = [(len(w), *scan_words(w, index)) for w in words]
            cols = list(zip(*rows)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64())
            yield pa.record_batch([b.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                  names=["id", "n_words", "n_base", "first_word", "last_word",
                                         "base_labels", "labels", "score", "n_blocks"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, n_words long, n_base long, first_word long, last_word long, "
                                "base_labels string, labels string, score double, n_blocks long")
