"""WARC archives and their index.

Writing: one record a page, each a gzip member of its own. A payload that an earlier page has (the smallest
page_id) becomes a revisit record without payload. Spark's text sink writes the members, so any store that Spark
reaches will do and its committer deals with lost executors: a member's last byte, the highest of its size, is
zero below 16 MiB, and the sink's line separator supplies it. Larger records go into several members.

Reading: each archive is parsed into a run of captures, sorted by URL key, time and page. The runs are parted by
key ranges, and within a range a loser tree merges the runs' slices, which gives all capture histories in order.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import settle

MEMBER = 8 << 20
LEVEL = 4
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
RECORD_ID = "urn:quernstone:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = ["url_key", "captured", "page_id"]
CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, at long, size long"


def url_key(url: str) -> str:
    """The host's labels from the right, then path and query, in lower case; fragments and a leading www. go."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and (parts.scheme, parts.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return url.strip().lower()
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{port}){tail}".lower()


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, captured: str, digest: str) -> bytes:
    """One record, not compressed."""
    payload = (html or "").encode()
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}",
        f"WARC-Date: {captured}",
        f"WARC-Record-ID: <{RECORD_ID}{'none' if page_id is None else page_id}>",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{RECORD_ID}{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """gzip members of at most MEMBER bytes each, whose last byte is therefore zero."""
    out = []
    for at in range(0, len(data), MEMBER):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        out.append(z.compress(data[at : at + MEMBER]) + z.flush())
    return b"".join(out)


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def write_archives(pages: DataFrame, path: str, least: int = 0, per_file: int = 20_000) -> None:
    """Writes pages (page_id, url, html) as archives below path.

    Of equal payloads of at least `least` bytes the one with the smallest page_id is a response and the others
    revisit it; rows that repeat that page_id are responses too, and so is a row without page_id. A null url is
    empty, a null html is an empty payload. Without a capture time in the data, page n's is n seconds from START.
    An empty table gives an archive without records.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    light = base.filter(F.octet_length("html") >= least).select("page_id", "sha")
    first = light.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    revisits = light.join(first, "sha").filter("page_id <> refers_to").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                out = []
                for page_id, url, html, sha, refers_to in zip(*[x.to_pylist() for x in batch.slice(at, 128).columns], strict=True):
                    captured = (START + datetime.timedelta(seconds=(page_id or 0) % (1 << 32))).strftime("%Y-%m-%dT%H:%M:%SZ")
                    out.append(packed(record(page_id, url, html, refers_to, captured, base32(sha)))[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    typed = base.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "sha", "refers_to")
    members = typed.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


def _header(data: bytes, name: bytes) -> str | None:
    at = data.find(b"\r\n" + name + b": ")
    if at < 0:
        return None
    at += len(name) + 4
    return data[at : data.index(b"\r\n", at)].decode()


def _page(record_id: str | None) -> int | None:
    text = (record_id or "").strip("<>").removeprefix(RECORD_ID)
    return int(text) if text and text != "none" else None


def records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed size and bytes of each record of an archive. A record may span members."""
    at, held, begun = 0, b"", 0
    while at < len(data):
        z = zlib.decompressobj(31)
        held += z.decompress(memoryview(data)[at : at + (1 << 16)])
        end = min(len(data), at + (1 << 16))
        while not z.eof:
            if end >= len(data):
                raise ValueError(f"a member at {begun} breaks off")
            held += z.decompress(memoryview(data)[end : end + (1 << 16)])
            end = min(len(data), end + (1 << 16))
        at = end - len(z.unused_data)
        head = held.find(b"\r\n\r\n")
        length = _header(held[: head + 2], b"Content-Length") if head >= 0 else None
        if length is not None and len(held) >= head + 8 + int(length):
            yield begun, at - begun, held
            held, begun = b"", at


def capture(data: bytes) -> tuple[str, str, int | None, int, str, str, int | None, str]:
    """The index entry of a record; a response's size and digest are taken from its payload."""
    head = data.index(b"\r\n\r\n")
    top = data[: head + 2]
    kind = _header(top, b"WARC-Type") or ""
    url = _header(top, b"WARC-Target-URI") or ""
    block = data[head + 4 : head + 4 + int(_header(top, b"Content-Length") or 0)]
    http = block.index(b"\r\n\r\n")
    declared = (_header(top, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
    if kind == "response":
        payload = block[http + 4 :]
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != declared:
            raise ValueError(f"the payload of {_header(top, b'WARC-Record-ID')} does not have its digest")
    else:
        size, digest = int(_header(block[: http + 2], b"Content-Length") or 0), declared
    return url_key(url), _header(top, b"WARC-Date") or "", _page(_header(top, b"WARC-Record-ID")), size, digest, kind, _page(_header(top, b"WARC-Refers-To")), url


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, sorted within its archive; seq is its place in that run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive = name.as_py()
                found = sorted(((*capture(data), archive, at, size) for at, size, data in records(content.as_py())), key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[9]))
                for k in range(0, len(found), 4096):
                    some = [(*x, k + i) for i, x in enumerate(found[k : k + 4096])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    text, number = pa.string(), pa.int64()
    schema = pa.schema(list(zip([x.split()[0] for x in f"{CAPTURE}, seq long".split(", ")], [text, text, number, number, text, text, number, text, text, number, number, number], strict=True)))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(run, f"{CAPTURE}, seq long")


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a pop replays one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs, self.k = runs, max(1, len(runs))
        self.heads: list[tuple | None] = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is not None and y is None else x is not None and (x, a) < (y, b)

    def _play(self, i: int) -> None:
        """Carries leaf i to the root; an empty node takes it (while the tree is filled) and ends the way."""
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._less(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[i := self.losers[0]]) is not None:
            yield head
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in the order of KEY: ranges of keys over partitions, the runs' slices merged within each.

    Range bounds include page_id, so one URL with a third of all captures still parts into many ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        columns = {name: table.column(name).to_pylist() for name in (*KEY, "archive", "seq")}
        slices: dict[str, list[tuple]] = {}
        for i, (key, when, page, archive, seq) in enumerate(zip(*columns.values(), strict=True)):
            slices.setdefault(archive, []).append((key, when, page is not None, page or 0, archive, seq, i))
        ordered = []
        for entries in slices.values():
            if any(a[5] > b[5] for a, b in zip(entries, entries[1:], strict=False)):  # the exchange need not keep a run's order
                entries.sort(key=lambda x: x[5])
            ordered.append(iter(entries))
        order = [x[-1] for x in LoserTree(ordered)]
        yield from table.take(order).drop_columns(["seq"]).to_batches(max_chunksize=8192)

    return runs.repartitionByRange(*KEY).mapInArrow(run, CAPTURE)


def archive_and_index(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Writes archives below path, reads them back, and returns their merged index (CAPTURE), a row for each page."""
    write_archives(pages, f"{path}/archives", least)
    runs = settle(read_runs(pages.sparkSession, f"{path}/archives"), f"{path}/runs")
    return merge_runs(runs)
