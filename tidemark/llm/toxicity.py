"""Document toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its
distinct words, where a word weighs what it and its beginnings weigh (stems
carry over to endings not seen in training). The document's score is the
noisy-or of its sentences, 1 - prod(1 - p). The weights are learned from
document labels alone, and the sentence scores then say where the offence lies.

Training runs over a bounded sample of labelled documents (``Sample``); scoring
reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import zlib
from array import array
from dataclasses import dataclass
from math import exp, fsum, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_TABLE

_ENDS = b".!?\n\r"
# Separators part words; the marks that end a sentence become line feeds.
_SENTENCES = bytes(10 if b in _ENDS else WORD_TABLE[b] for b in range(256))


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample: documents of each label (the ones with the
    smallest hash of their id), bytes of a training text, features of the model,
    and how far a feature's share of toxic documents must be from chance."""
    per_label: int = 3000
    text_bytes: int = 64 << 10
    features: int = 4000
    least_documents: int = 4
    least_z: float = 4.0


BEGINNINGS = (3, 4, 5, 6)  # bytes
CACHED_WORDS = 500_000


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict  # by feature


def features(word: bytes) -> list[bytes]:
    """The word itself (marked by a space) and its beginnings."""
    return [word + b" ", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


class WordWeights(dict):
    """Weight of each word, worked out once; remembers a bounded number."""

    def __init__(self, model: Model):
        self.bias, self.known = model.bias, model.weights

    def __missing__(self, word: bytes) -> float:
        w = fsum(self.known.get(f, 0.0) for f in features(word))
        if len(self) < CACHED_WORDS:
            self[word] = w
        return w

    def sentence(self, words) -> float:
        return self.bias + fsum(map(self.__getitem__, words))


def sentences(text: str | None) -> list[set]:
    """The distinct words of each sentence; a text without words is one empty sentence."""
    found = [set(s.split()) for s in (text or "").encode().translate(_SENTENCES).split(b"\n")]
    return [s for s in found if s] or [set()]


class Bags:
    """Texts as numbers: each word once, sentences as arrays of word numbers, so
    that the sample takes little of the driver's memory."""

    def __init__(self, texts):
        self.words: dict[bytes, int] = {}
        flat, lengths, sizes = array("i"), array("q"), array("q")
        for text in texts:
            found = sentences(text)
            sizes.append(len(found))
            for s in found:
                lengths.append(len(s))
                flat.extend(self.words.setdefault(w, len(self.words)) for w in sorted(s))
        self.flat, self.lengths, self.sizes = np.array(flat, np.int32), np.array(lengths, np.int64), np.array(sizes, np.int64)
        names: dict[bytes, int] = {}
        own = [[names.setdefault(f, len(names)) for f in features(w)] for w in self.words]
        self.features = list(names)
        self.per_word = np.array([len(x) for x in own], np.int64)
        self.of_word = np.array([i for x in own for i in x], np.int32)

    def documents(self):
        """Word numbers of each document."""
        ends = np.cumsum(np.concatenate([[0], self.lengths]))
        at = 0
        for n in self.sizes.tolist():
            yield self.flat[ends[at]:ends[at + n]]
            at += n

    def spread(self, words: np.ndarray, counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``words``, value) of each word's ``counts`` values."""
        starts = np.cumsum(counts) - counts
        n = counts[words]
        index = np.repeat(np.arange(len(words)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return index, values[np.repeat(starts[words], n) + inside]


def _chosen(bags: Bags, labels: np.ndarray, sample: Sample) -> list[int]:
    """Features by how far their share of toxic documents is from chance (z score)."""
    counts = np.zeros((2, len(bags.features)))
    for words, y in zip(bags.documents(), labels):
        held = np.unique(bags.spread(np.unique(words), bags.per_word, bags.of_word)[1])
        counts[int(y > 0), held] += 1
    n = counts.sum(0)
    share = labels.mean()
    z = np.abs(counts[1] - n * share) / np.sqrt(n * share * (1 - share) + 1e-9)
    found = np.nonzero((n >= sample.least_documents) & (z >= sample.least_z))[0].tolist()
    return sorted(found, key=lambda i: (-z[i], bags.features[i]))[:sample.features]


def train(texts: list[str], labels: list[int], weights: list[float] | None = None,
          sample: Sample = Sample(), steps: int = 200, rate: float = 0.4, decay: float = 2e-5) -> Model:
    """Noisy-or likelihood over documents, by Adam from zero weights."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(share / (1 - share))) if len(y) else -5.0, {})
    bags = Bags(texts)
    chosen = _chosen(bags, y, sample)
    vocabulary = [bags.features[i] for i in chosen]
    number = np.full(len(bags.features), -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    doc = np.repeat(np.arange(len(y)), bags.sizes)
    # Chosen features alone, by word, and then by sentence.
    of_word = number[bags.of_word]
    word_of = np.repeat(np.arange(len(bags.per_word)), bags.per_word)
    kept_of = np.bincount(word_of[of_word >= 0], minlength=len(bags.per_word))
    index, word = bags.spread(bags.flat, kept_of, of_word[of_word >= 0])
    at = np.repeat(np.arange(len(bags.lengths)), bags.lengths)[index]
    share = np.ones(len(y)) if weights is None else np.array(weights, float)
    share = share / share.sum()
    params = np.zeros(len(vocabulary) + 1)
    params[-1] = -4.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        z = params[-1] + np.bincount(at, params[word], minlength=len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))  # log(1 - P)
        some = np.maximum(-np.expm1(none), 1e-9)
        slope = np.where(y > 0, -np.exp(none) / some, 1.0) * share
        dz = slope[doc] * p
        grad = np.append(np.bincount(word, dz[at], minlength=len(vocabulary)) + decay * params[:-1], dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8) * (1 - step / (steps + 1))
    kept = {w: float(c) for w, c in zip(vocabulary, params) if abs(c) > 1e-3}
    return Model(float(params[-1]), kept)


def _chance(z: float) -> float:
    return 1 / (1 + exp(-max(-30.0, min(30.0, z))))  # below 1 in doubles


def score(text: str | None, weights: WordWeights) -> tuple[float, int, float, int, int]:
    """(document score, index and score of its worst sentence, sentences, sentences at 0.5 or more)."""
    none, worst, worst_at, n, over = 0.0, -1.0, 0, 0, 0
    for s in (text or "").encode().translate(_SENTENCES).split(b"\n"):
        words = set(s.split())
        if not words:
            continue
        p = _chance(weights.sentence(words))
        none += log1p(-p)
        if p > worst:
            worst, worst_at = p, n
        over += p >= 0.5
        n += 1
    if not n:
        p = _chance(weights.bias)
        return p, 0, p, 1, int(p >= 0.5)
    return 1 - exp(none), worst_at, worst, n, over


def sentence_scores(text: str | None, weights: WordWeights) -> list[tuple[int, int, float]]:
    """(first byte, end byte, score) of each sentence that has words."""
    out, at = [], 0
    for s in (text or "").encode().translate(_SENTENCES).split(b"\n"):
        if words := set(s.split()):
            out.append((at, at + len(s), _chance(weights.sentence(words))))
        at += len(s) + 1
    return out


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: Sample = Sample()) -> Model:
    """Train on the bounded sample of labelled rows that aren't held out."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    # A document labelled both ways counts as toxic; repeated rows count once.
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    shares = {r.y: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.octet_length("text") <= sample.text_bytes)
    rows = []
    for y in sorted(shares):
        # The sample's ids first, so that only its texts move.
        few = marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample.per_label)
        rows += [(r.id, r.text, y) for r in texts.join(F.broadcast(few.select("id")), "id", "left_semi")
                 .dropDuplicates(["id"]).toLocalIterator()]
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0])))
    picked = {y: sum(r[2] == y for r in rows) for y in shares}
    each = [shares[y] / max(1, picked[y]) for _, _, y in rows]
    return train([r[1] for r in rows], [r[2] for r in rows], each, sample)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, n_sentences,
    n_offending, worst_sentence (its index) and worst_score.

    Nulls: a null or wordless text is one empty sentence; a null id is not held
    out. Equal texts get equal scores, repeated rows included. Whole texts of
    any length are read. Other columns are ignored. Without training rows of
    both labels the model is the bare share of label 1.
    """
    def run(batches):
        weights = WordWeights(model)
        for b in batches:
            got = [score(t, weights) for t in b.column("text").to_pylist()]
            s, at, worst, n, over = zip(*got) if got else ((),) * 5
            yield pa.record_batch(
                [b.column("id"), b.column("held_out"), pa.array(s, pa.float64()),
                 pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array(n, pa.int64()),
                 pa.array(over, pa.int64()), pa.array(at, pa.int64()), pa.array(worst, pa.float64())],
                names=["id", "held_out", "score", "predicted", "n_sentences", "n_offending",
                       "worst_sentence", "worst_score"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, held_out boolean, score double, predicted int, n_sentences long, "
                                "n_offending long, worst_sentence long, worst_score double")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input's rows that score below the threshold, columns as they are."""
    def run(batches):
        weights = WordWeights(model)
        for b in batches:
            scores = [score(t, weights)[0] for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
