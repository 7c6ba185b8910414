import hashlib
import random

from pyspark.sql import functions as F

from llm import small
from tidemark.llm import decontam

COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def plain(values, items):
    windows: dict = {}
    for i, t in items:
        ws = small.words(t)
        n = min(10, len(ws))
        for j in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[j:j + n]), set()).add(str(i))
    out = []
    for d, t in enumerate(values):
        ws, hit, found = small.words(t), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(ws) - n + 1):
                if own := windows.get(tuple(ws[s:s + n])):
                    hit |= set(range(s, s + n))
                    found |= own
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(ws), len(hit), len(found), ids, bool(hit)))
    return out


def case():
    rng = random.Random(8)
    items = [(i, small.prose(rng, rng.randrange(10, 40))) for i in range(12)]
    items += [(12, "tiny one"), (13, "Ab"), (14, None), (15, ""), (16, items[0][1]), (16, items[0][1]), (2, "again id")]
    values = small.texts()
    for _, t in items[:8]:
        ws = (t or "").split()
        for n in (9, 10, 14):
            at = rng.randrange(max(1, len(ws) - n + 1))
            part = " ".join(ws[at:at + n])
            values.append(f"{small.prose(rng, 30)} {part.upper() if n == 14 else part} {small.prose(rng, 5)}")
    values += [items[3][1] + " " + items[3][1], "a tiny-one, TINY ONE", "ab", "AB ab", items[5][1]]
    return values, items


def test_against_brute_force(spark):
    values, items = case()
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontam.find(small.with_clashes(small.documents(spark, values)), bench, keep=["doc_id"])
    assert small.rows(got, *COLUMNS) == plain(values, items)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    values, items = case()
    items = [x for x in items if len(small.words(x[1])) >= 10]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontam.find(small.documents(spark, values), bench, keep=["doc_id"])
    assert small.rows(got, *COLUMNS) == plain(values, items)


def test_empty_tables_and_repeats(spark):
    values, items = case()
    bench = spark.createDataFrame(items, "item_id int, text string")
    docs = small.repeated(small.documents(spark, values))
    assert decontam.find(docs.limit(0), bench).count() == 0
    assert decontam.find(docs, bench.limit(0)).where("contaminated OR n_items > 0").count() == 0
    clean = [d for d, *_, bad in plain(values, items) if not bad]
    kept = decontam.drop_contaminated(small.with_clashes(docs), bench)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(clean * 2)
    assert kept.where("doc_id IS NULL").count() == len(clean)


def test_main_path_is_native(spark):
    values, items = case()
    bench = spark.createDataFrame(items, "item_id int, text string")
    plan = decontam.find(small.documents(spark, values), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_windows_hold_no_ids(spark):
    rng = random.Random(9)
    passage = small.prose(rng, 30)
    items = [(i, f"{small.prose(rng, 12)} {passage}") for i in range(60)] + [(None, passage), (None, small.prose(rng, 11))]
    bench = spark.createDataFrame(items, "item_id int, text string")
    wins, sets = decontam.item_windows(bench, "item_id", "text")
    assert {t for _, t in wins.dtypes} == {"int", "bigint"}
    # The passage's windows share one set of all items, named once.
    crowd = sets.groupBy("s1", "s2").count().where("count = 60").count()
    assert crowd == 1
    values = [passage, f"{small.prose(rng, 20)} {passage}", items[-1][1], items[4][1]]
    got = decontam.find(small.documents(spark, values), bench, keep=["doc_id"])
    assert small.rows(got, *COLUMNS) == plain(values, [x for x in items if x[0] is not None])[:2] + [
        (2, 11, 11, 0, hashlib.sha256(b"").hexdigest(), True)] + plain(values, items[:60])[3:]


def test_columns_named_like_the_results_give_way(spark):
    docs = spark.createDataFrame([(1, "one two three four", 99, "mine")], "doc_id long, text string, n_words int, `_k1` string")
    items = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    got = decontam.find(docs, items)
    assert got.columns == ["doc_id", "text", "_k1", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    row = got.first()
    assert (row.n_words, row.n_hit, row.n_items, row._k1) == (4, 2, 1, "mine")


def test_values_over_neighbours(spark):
    df = spark.createDataFrame([([5, 3, 9, 1, 7, 2, 8, 4, 6, 0, 11],), ([],), ([4],)], "v array<bigint>")
    for n in range(1, 12):
        got = [r.out for r in decontam._over(df, "v", n, lambda a, b: F.least(a, b), "out").collect()]
        assert got == [[min(r.v[i:i + n]) for i in range(len(r.v) - n + 1)] for r in df.collect()]
