import random
import zlib

import pytest

from llm import small
from tidemark.llm import toxicity

RUDE = ["bramk", "zolt", "grell"]


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    values, marks = [], []
    for _ in range(n):
        lines = [small.prose(rng, rng.randrange(4, 12)) for _ in range(rng.randrange(1, 8))]
        bad = rng.random() < 0.3
        if bad:
            stem = rng.choice(RUDE)
            at = rng.randrange(len(lines))
            lines[at] += " " + " ".join(stem + rng.choice(["", "en", "ta", "ré"]) for _ in range(2))
        values.append(". ".join(lines))
        marks.append(int(bad))
    return values, marks


def test_held_out_accuracy_and_offending_sentence(spark):
    values, marks = corpus()
    docs = small.with_clashes(small.documents(spark, values)).withColumnRenamed("id", "other_id")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in range(len(values)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i, r in got.items() if r.held_out) == held
    right = [got[i].predicted == marks[i] for i in held]
    assert sum(right) / len(right) > 0.95
    weights = toxicity.WordWeights(model)
    for i in held:
        if marks[i] and got[i].predicted:
            first, end, _ = max(toxicity.sentence_scores(values[i], weights), key=lambda s: s[2])
            part = values[i].encode()[first:end].decode().lower()
            assert any(stem in part for stem in RUDE) and got[i].n_offending >= 1


def test_held_out_rows_are_never_trained_on(spark):
    values, marks = corpus()
    docs = small.documents(spark, values)
    turned = [1 - m if zlib.crc32(str(i).encode()) % 5 == 0 else m for i, m in enumerate(marks)]
    models = [toxicity.fit(docs, spark.createDataFrame(list(enumerate(m)), "doc_id long, toxic int"))
              for m in (marks, turned)]
    assert models[0] == models[1]


def test_scores_follow_noisy_or():
    model = toxicity.Model(-3.0, {b"bad ": 4.0, b"bad": 1.0})
    weights = toxicity.WordWeights(model)
    p = lambda z: 1 / (1 + 2.718281828459045 ** -z)
    score, at, worst, n, over = toxicity.score("fine. Bad bad!\n\nbadly so? ", weights)
    assert score == pytest.approx(1 - (1 - p(-3)) * (1 - p(2)) * (1 - p(-2)))
    assert (at, n, over) == (1, 3, 1) and worst == pytest.approx(p(2))
    assert toxicity.score(None, weights)[0] == toxicity.score(" .. ", weights)[0] == pytest.approx(p(-3))


@pytest.mark.parametrize("marks", [[], [0, 0, 0], [1, 1, 1]])
def test_one_sided_labels_and_edge_rows(spark, marks):
    docs = small.repeated(small.documents(spark, ["a b", None, "", "x" * 100_000]))
    labels = spark.createDataFrame(list(enumerate(marks)) + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    kept = toxicity.drop_toxic(small.with_clashes(docs), model)
    assert kept.columns == small.with_clashes(docs).columns
    assert kept.count() == sum(r.score < 0.5 for r in got)
