import random
from math import ceil

from llm import small
from tidemark.llm import license_scan as ls


def plain(values, threshold=ls.THRESHOLD):
    """All blocks against all templates, and all places of all phrases."""
    out = []
    for i, t in enumerate(values):
        ws = small.words(t)
        starts, base, labels, score, blocks = [], set(), set(), 0.0, set()
        firsts = list(range(0, max(1, len(ws) - ls.BLOCK + ls.STRIDE), ls.STRIDE)) if ws else []
        for phrase, label in ls.PHRASES:
            own = phrase.split()
            at = [k for k in range(len(ws) - len(own) + 1) if ws[k:k + len(own)] == own]
            if at:
                starts += at
                base.add(label)
                score = 1.0
            blocks |= {b for b in firsts if set(own) <= set(ws[b:b + ls.BLOCK])}
        for notice, label, must in ls.NOTICES:
            own = set(notice.split())
            for b in firsts:
                share = len(own & set(ws[b:b + ls.BLOCK])) / len(own)
                if set(must.split()) <= set(ws[b:b + ls.BLOCK]) and share >= (1 if len(own) <= ls.ALL_WORDS_UP_TO else threshold):
                    labels.add(label)
                    blocks.add(b)
                    score = max(score, share)
        out.append((i, len(ws), len(starts), min(starts, default=None), max(starts, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | labels)), score, len(blocks)))
    return out


COLUMNS = ("id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks")


def case():
    rng = random.Random(6)
    values = small.texts()
    for notice, *_ in [*ls.NOTICES, *ls.PHRASES]:
        own = notice.split()
        for keep in (1.0, 0.85, 0.75):
            part = [w.upper() if rng.random() < 0.3 else w for w in own if rng.random() < keep]
            values.append(f"{small.prose(rng, rng.randrange(150))} {' '.join(part)}, {small.prose(rng, rng.randrange(150))}")
    values += ["cc by CC-BY; cc by", "cc " * 5 + "by", "All rights\nreserved. General Public License", "by cc"]
    values.append(" ".join(["all rights reserved"] * 500))
    return values


def test_against_brute_force(spark):
    values = case()
    got = ls.scan(small.with_clashes(small.documents(spark, values)).drop("n_words").withColumnRenamed("id", "x"))
    assert small.rows(got, *COLUMNS) == plain(values)


def test_prefix_order_is_by_documents_of_the_corpus(spark):
    df = small.documents(spark, ["license license the", "the", "the mit", None])
    assert ls.documents_with(df, {b"the", b"license", b"mit", b"bsd"}) == {b"the": 3, b"license": 1, b"mit": 1}


def test_repeats_null_ids_and_empty(spark):
    df = small.repeated(small.documents(spark, ["cc by", None, ""]))
    got = ls.scan(df)
    assert got.count() == 9 and got.where("base_labels = 'cc-by'").count() == 3
    assert ls.scan(df.limit(0)).count() == 0


def test_threshold_holds_for_every_notice():
    own = ls.templates()
    for threshold in (0.5, 0.8, 1.0):
        index = ls.Index(own, {}, threshold)
        for t, need in zip(own, index.needs):
            assert need == (len(set(t.words)) if t.phrase else ceil(threshold * len(set(t.words))))


def label_of(text):
    index = ls.Index(ls.templates(), {})
    return ls.scan_words(ls.word_bytes(text), index)[4].split(",")


def test_short_notice_with_a_word_missing():
    assert "apache-2.0" in label_of("Licensed under the Apache License 2.0")
    assert "mit" in label_of("Released under MIT, the text says")
    assert "mit" not in label_of("Released under MIT")


def test_notice_in_one_unaligned_block_only():
    notice = dict((n, t) for t, n, _ in ls.NOTICES)["isc"].split()
    own = list(dict.fromkeys(notice))
    need = ceil(ls.THRESHOLD * len(own))
    # The needed words, the first and the last 64 words apart: one block holds them all.
    held = own[:need - 1] + ["x"] * (ls.BLOCK - need) + own[need - 1:need]
    for lead in range(40):
        words = ["y"] * lead + held + ["y"] * 100
        assert label_of(" ".join(words)) == ["isc"]
        index = ls.Index(ls.templates(), {})
        assert ls.scan_words([w.encode() for w in words], index)[6] == 1
        assert label_of(" ".join(["y"] * lead + held[:need - 1] + ["x"] + held[need - 1:] + ["y"] * 100)) == [""]


def test_every_block_against_brute_force():
    rng = random.Random(8)
    vocabulary = sorted({w for t, *_ in [*ls.NOTICES, *ls.PHRASES] for w in t.split()}) + ["x"] * 60
    for _ in range(60):
        values = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(300)))]
        for threshold in (0.5, 0.8):
            index = ls.Index(ls.templates(), {}, threshold)
            got = [(0, len(w), *ls.scan_words(w, index)) for w in map(ls.word_bytes, values)]
            assert got == plain(values, threshold)


def test_no_label_without_the_words_that_name_the_licence():
    assert label_of("Released under the GNU General Public License") == ["gpl"]
    assert label_of("The report was released last week under a new press license agreement") == [""]
    assert label_of("Licensed under the Apache License, Version 2.0") == ["apache-2.0"]
    assert label_of("This text is licensed under CC BY.") == ["cc-by"]
    assert label_of("licensed under CC-BY-SA 4.0") == ["cc-by", "cc-by-sa"]
    for notice, label, must in ls.NOTICES:
        assert set(must.split()) <= set(notice.split()) and label in label_of(notice)
        for word in must.split():
            assert label not in label_of(" ".join(w for w in notice.split() if w != word))
