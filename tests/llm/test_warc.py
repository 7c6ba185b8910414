import gzip
import hashlib
import random

from llm import small
from tidemark.llm import warc
from tidemark.llm.files import open_file

PAGES = "page_id long, url string, html string, captured long, digest string"


def pages(spark, seed=3):
    rng = random.Random(seed)
    bodies = [None, "", "x" * 99, "x" * 99, "é" * 50, "é" * 50, "y" * 100, "y" * 100, "y" * 100] + \
        ["<p>" + small.prose(rng, 60) for _ in range(20)]
    bodies += bodies[12:16] * 2 + [small.prose(rng, 20_000), "a\r\n\r\nWARC/1.1\r\n\x00"]
    urls = [None, "", "http://www.B.example/a?x=1#f", "https://a.example:80/\r\nq z", "http://[bad/"]
    rows = [(i, rng.choice(urls), b, rng.randrange(10 ** 6), "own") for i, b in enumerate(bodies)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, PAGES)


def plain(rows):
    first, out = {}, []
    for i, _, html, *_ in sorted(rows):
        raw = (html or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        again = len(raw) >= 100 and digest in first
        out.append((i, len(raw), digest, "revisit" if again else "response", first[digest] if again else None))
        first.setdefault(digest, i)
    return out


COLUMNS = ("id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip_and_global_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 10)
    rows, df = pages(spark)
    got = warc.archive(df.repartition(3), time_col="captured")
    assert small.rows(got, *COLUMNS) == plain(rows)
    ordered = [(r.url_key, r.seconds, r.id) for r in got.collect()]
    assert ordered == sorted(ordered) == sorted((warc.url_key(warc._header(u or "")), s, i) for i, u, _, s, _ in rows)
    assert got.select("run").distinct().count() > 3


def test_records_are_read_at_their_offsets(spark):
    rows, df = pages(spark)
    html = {i: (h or "").encode() for i, _, h, *_ in rows}
    for r in warc.archive(df).collect():
        with open_file(r.run) as f:
            f.seek(r.offset)
            headers, payload, _ = warc.parse(gzip.decompress(f.read(r["size"])))
        assert headers["WARC-Type"] == r.record_type
        assert payload == (html[r.id] if r.record_type == "response" else b"")


def test_loser_tree():
    rng = random.Random(7)
    for k in range(9):
        runs = [sorted(rng.randrange(30) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.merge(runs, key=lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_repeats_null_ids_and_empty(spark):
    body = "z" * 200
    df = spark.createDataFrame([(5, None, body, None, ""), (5, None, body, None, ""), (7, "u", body, 1, ""),
                                (None, "u", body, 1, "")], PAGES)
    assert small.rows(warc.archive(df), "id", "record_type", "refers_to") == [
        (5, "response", None), (5, "response", None), (7, "revisit", 5), (None, "revisit", 5)]
    nulls = warc.archive(df.where("page_id IS NULL").union(df.where("page_id IS NULL")))
    assert {r.record_type for r in nulls.collect()} == {"response"}
    assert warc.archive(df.limit(0)).count() == 0
