"""WARC archives with revisit records, and their capture index by external merge.

Tasks write gzip archives (a member per record) into the shared folder, and
read them back record by record. What a task reads of one archive is sorted by
(URL key, time, page) into a run and stored. Runs are then cut at global range
bounds over the whole sort key, so captures of one much-visited URL may fall
into several ranges, and in each range a loser tree merges the runs' slices.
The result's partitions hold the capture histories in global order.
"""

from __future__ import annotations

import hashlib
import zlib
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import run_dir, stored
from tidemark.llm.files import new_file, open_file
from tidemark.sources.paths import qualified

LEAST_REVISIT = 100           # payloads below this are never revisits
ARCHIVE_BYTES = 64 << 20
RANGE_CAPTURES = 100_000      # captures a merge task holds, without payloads
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower case: the sort key of capture indexes."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + tail


def _header(value: str) -> str:
    return quote(value, safe="".join(map(chr, range(33, 127))) + " ")


def record(page_id: int | None, url: str | None, seconds: int, payload: bytes, digest: str,
           revisit: bool, refers_to: int | None) -> bytes:
    """One WARC 1.1 record, as a gzip member."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Date: {datetime.fromtimestamp(seconds, UTC).strftime('%Y-%m-%dT%H:%M:%SZ')}",
             f"WARC-Target-URI: {_header(url or '')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def members(stream, chunk: int = 1 << 16):
    """(offset, size, bytes) of each gzip member."""
    at, held = 0, b""
    while True:
        if not held:
            held = stream.read(chunk)
            if not held:
                return
        unpacker, out, used = zlib.decompressobj(31), [], 0
        while True:
            out.append(unpacker.decompress(held))
            used += len(held)
            if unpacker.eof:
                break
            held = stream.read(chunk)
            if not held:
                raise ValueError("the archive ends inside a record")
        held = unpacker.unused_data
        used -= len(held)
        yield at, used, b"".join(out)
        at += used


def parse(raw: bytes) -> tuple[dict, bytes, int]:
    """(WARC headers, HTTP payload, length the HTTP headers state) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    return headers, payload, stated


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number not in ("", "None") else None


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   time_col: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the archives; the stored manifest has (path, records)."""
    folder = qualified(pages.sparkSession, folder or run_dir(pages.sparkSession, "warc"))
    html = F.coalesce(F.col(html_col), F.lit(""))
    seconds = F.coalesce(F.col(time_col).cast("long"), F.lit(0)) if time_col else F.lit(0).cast("long")
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                       seconds.alias("seconds"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    # Copies only: this side is small where copies are few, and AQE then broadcasts it by measured size.
    firsts = own.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    judged = own.join(firsts, "digest", "left").select(
        "id", "url", "seconds", "html", "digest", F.when(F.col("id").eqNullSafe(F.col("first")), None)
        .otherwise(F.col("first")).alias("refers_to"))

    def run(batches):
        out = None
        size = count = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "seconds", "html", "digest", "refers_to"))):
                id_, url, sec, text, digest, refers = r
                if out is None:
                    uri, out = new_file(folder, "capture", ".warc.gz")
                    size = count = 0
                data = record(id_, url, sec, text.encode(), digest, refers is not None, refers)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.record_batch([pa.array([uri]), pa.array([count], pa.int64())], names=["path", "records"])
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([uri]), pa.array([count], pa.int64())], names=["path", "records"])

    return stored(judged.mapInArrow(run, "path string, records long"), "archives")


_CAPTURE = ("run string, url_key string, seconds long, id long, payload_bytes long, payload_digest string, "
            "record_type string, refers_to long, offset long, size long")
_NAMES = [x.split()[0] for x in _CAPTURE.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64()}
_TYPES = [_KINDS[x.split()[1]] for x in _CAPTURE.split(", ")]


def _order(row: tuple) -> tuple:
    """Sort key of a capture: URL key, time, page (none first), place in its archive."""
    return (row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[8])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def read_runs(manifest: DataFrame) -> DataFrame:
    """Read every archive back; each becomes a sorted run of captures."""
    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with open_file(path) as stream:
                    for offset, size, raw in members(stream):
                        headers, payload, stated = parse(raw)
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response":
                            stated, found = len(payload), hashlib.sha256(payload).hexdigest()
                            if found != digest:
                                raise ValueError(f"payload digest differs in {path} at {offset}")
                        when = datetime.fromisoformat(headers["WARC-Date"])
                        rows.append((path, url_key(headers["WARC-Target-URI"]), int(when.timestamp()),
                                     _page(headers["WARC-Record-ID"]), stated, digest, kind,
                                     _page(headers.get("WARC-Refers-To")), offset, size))
                rows.sort(key=_order)
                for i in range(0, len(rows), 10_000):
                    yield _batch(rows[i:i + 10_000])

    files = max(1, manifest.count())
    return stored(manifest.select("path").repartition(min(files, 20_000), "path").mapInArrow(run, _CAPTURE), "runs")


def merge(runs: list[list], key=_order):
    """k-way merge of sorted runs by a loser tree: every inner node keeps the
    loser of its match, so the next winner takes one match a level."""
    k = len(runs)
    if k == 0:
        return
    heads = [iter(r) for r in runs]
    end = (1,)
    now = []
    for h in heads:
        x = next(h, None)
        now.append((end, None) if x is None else ((0, key(x)), x))
    tree = [0] * k                      # tree[1:] are losers, tree[0] the winner
    winners = [0] * k + list(range(k))  # by node, leaves last
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        if now[b][0] < now[a][0]:
            a, b = b, a
        winners[node], tree[node] = a, b
    tree[0] = winners[1] if k > 1 else 0
    while now[tree[0]][0] != end:
        best = tree[0]
        yield now[best][1]
        x = next(heads[best], None)
        now[best] = (end, None) if x is None else ((0, key(x)), x)
        node = (best + k) // 2
        while node:
            if now[tree[node]][0] < now[best][0]:
                best, tree[node] = tree[node], best
            node //= 2
        tree[0] = best


def capture_index(runs: DataFrame) -> DataFrame:
    """All captures, ordered by (URL key, time, page) over the partitions and inside each."""
    ranges = max(1, -(-runs.count() // RANGE_CAPTURES))
    cut = runs.repartitionByRange(ranges, "url_key", "seconds", "id", "run", "offset")
    # The shuffle mixes the runs' slices; by run again, each slice is in order.
    cut = cut.sortWithinPartitions("run", "url_key", "seconds", "id", "offset")

    def run(batches):
        slices: dict[str, list] = {}
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _NAMES)):
                slices.setdefault(row[0], []).append(row)
        out = []
        for row in merge(list(slices.values())):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return cut.mapInArrow(run, _CAPTURE)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            time_col: str | None = None) -> DataFrame:
    """Write WARC records of all pages, read them back, merge the index: one row
    per input row with run (the archive), url_key, seconds, id, payload_bytes,
    payload_digest, record_type, refers_to, offset and size.

    Of equal payloads of at least LEAST_REVISIT bytes the smallest id is the
    response and the others revisit it; rows that repeat the smallest id are
    responses too. Nulls: a null html is an empty payload, a null URL an empty
    URI, a null time 0, a null id is written without number and never the
    smallest (copies that all lack ids are responses). Other columns are
    ignored. An empty table writes no archive.
    """
    return capture_index(read_runs(write_archives(pages, id_col, url_col, html_col, time_col)))
