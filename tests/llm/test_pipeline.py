"""The stages on a small corpus, each against its operator's plain version on its own input."""
import random

import pytest

import corpus_pipeline
from llm import small
from llm.test_decontam import plain as contaminated
from llm.test_simhash import plain as fingerprint
from llm.test_suffix_dedup import plain as repeats


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(i, small.prose(rng, 25)) for i in range(5)]
    values = small.texts() + [f"{small.prose(rng, 20)} {t} end" for _, t in items[:3]]
    values += [f"{small.prose(rng, 12)}. {'bramk' if i % 2 else 'calm'} {small.prose(rng, 6)}" for i in range(120)]
    marks = [(i, int("bramk" in (t or ""))) for i, t in enumerate(values)]
    small.documents(spark, values).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, values, items


def test_stages(spark, case):
    folder, values, items = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "test")
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r for r in docs.collect()}

    assert not any("bramk" in (r.text or "") for r in seen["toxicity"].values())
    assert {i for i, t in enumerate(values) if "bramk" not in (t or "")} == set(seen["toxicity"])

    own = sorted(seen["toxicity"])
    fps = [fingerprint(values[i]) for i in own]
    roots = small.components(len(own), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert set(seen["simhash"]) == {own[r] for r in roots}

    own = sorted(seen["simhash"])
    removed = {own[i]: n for i, _, n, _, _ in repeats([values[i] for i in own], 400)}
    assert set(seen["suffix_array"]) == set(own)
    for i, r in seen["suffix_array"].items():
        assert (r.text == values[i]) == (removed[i] == 0)
        assert r.n_chars is None or r.n_chars == len(r.text or "")

    own = sorted(seen["suffix_array"])
    bad = {own[d] for d, *_, hit in contaminated([seen["suffix_array"][i].text for i in own], items) if hit}
    assert bad and set(seen["decontaminate"]) == set(own) - bad
    assert set(seen["pack"]) == set(seen["decontaminate"])


def test_run_equals_its_stages(spark, case):
    folder, _, _ = case
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "test")
    cols = ("doc_id", "n_tokens", "bucket", "bucket_tokens", "batch", "slot", "padding")
    assert small.rows(corpus_pipeline.run(spark, folder), *cols) == small.rows(docs, *cols)


def test_empty_and_wide_documents(spark, case):
    folder, values, _ = case
    docs = small.with_clashes(small.documents(spark, values))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name != "pack":
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.count() > 0
