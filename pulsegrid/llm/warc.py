"""WARC archives: writing pages, reading records back, and reassembling segmented records.

Every task writes one archive of whole and first records and one of continuations, each record a gzip
member; blocks of over `segment_bytes` are cut into a first segment and continuation records. When
read, continuations are grouped by their origin, ordered by segment number, checked against the total
length, and the chunked framing of the payload is decoded; digests are verified.

Null pages are empty payloads; null addresses stand as none. Of equal payloads the row with the
largest id (nulls lowest, then any one row) is the response and the others revisit it, repeated rows
too. A record that can't be restored is returned with what is wrong in `status`, `ok` otherwise.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh_path, join_groups, written

#: Bytes of a block beyond which it is segmented, of a chunk of the payload, of a batch given back.
SEGMENT_BYTES, CHUNK, OUT_BYTES = 8192, 4096, 8 << 20
#: Revisits (24 bytes each) that may be broadcast; beyond that pages are shuffled by their key.
FEW_REVISITS = 500_000
_URN = "urn:page:"
_NAME = re.compile(rb"([^:\s]+):[ \t]*(.*)")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"file:/(?!/)", uri) or "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(uri)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[at : at + size]), payload[at : at + size]) for at in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked framing; None if the framing is broken."""
    at, out = 0, []
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2
    return None


def record(kind: str, record_id: str, fields: dict[str, object], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", **fields, "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + deflate.flush()


def page_records(page_id: int | None, key: int, url: str | None, payload: bytes, refers_to: tuple[int | None, int] | None, segment_bytes: int, date: str) -> tuple[bytes, list[bytes]]:
    """The page's first record and its continuations."""
    own = f"{_URN}{'' if page_id is None else page_id}:{key}"
    fields: dict[str, object] = {"WARC-Date": date, "WARC-Target-URI": None if url is None else urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~"), "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "Content-Type": "application/http; msgtype=response"}
    if refers_to is not None:
        other = f"{_URN}{'' if refers_to[0] is None else refers_to[0]}:{refers_to[1]}"
        fields |= {"WARC-Refers-To": f"<{other}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return record("revisit", own, fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)), []
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return record("response", own, fields, block), []
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    more = []
    for n, part in enumerate(parts[1:], 2):
        total = {"WARC-Segment-Total-Length": len(block)} if n == len(parts) else {}
        more.append(record("continuation", f"{own}:{n}", {"WARC-Date": date, "WARC-Segment-Origin-ID": f"<{own}>", "WARC-Segment-Number": n, **total}, part))
    return record("response", own, fields | {"WARC-Segment-Number": 1}, parts[0]), more


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (page_id, url, html) to `folder` (a new one in the shared folder if None); the archives: path, bytes.

    A task that runs again writes files of another name; only those of the attempt that counted are named.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    keyed = written(pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"), F.monotonically_increasing_id().alias("key")), "pages")
    able = keyed.where(F.col("size") >= min_bytes).select("digest", "page_id", "key")
    groups = able.groupBy("digest").agg(F.max(F.struct("page_id", "key")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written(groups, "payloads")
    total = groups.agg(F.sum("n")).first()[0] or 0
    # only what is found again is looked up: ids, not pages, are shuffled
    found = join_groups(able.select("digest", "key"), groups, "digest", "n", total).where(F.col("first.key") != F.col("key"))
    revisits = written(found.select("key", "first"), "revisits")
    rows = keyed.join(F.broadcast(revisits) if revisits.count() <= FEW_REVISITS else revisits, "key", "left").select("page_id", "key", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, path = filesystem(folder)
        task = TaskContext.get()
        names = [f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz" for kind in ("pages", "continuations")]
        streams: list = [None, None]
        sizes = [0, 0]

        def put(k: int, data: bytes) -> None:
            if streams[k] is None:
                fs.create_dir(path, recursive=True)
                streams[k] = fs.open_output_stream(f"{path}/{names[k]}", compression=None)
                data = record("warcinfo", f"urn:archive:{names[k]}", {"WARC-Date": date, "WARC-Filename": names[k], "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n") + data
            streams[k].write(data)
            sizes[k] += len(data)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for page_id, key, url, text, first in zip(*columns, strict=True):
                whole, more = page_records(page_id, key, url, text.encode(), (first["page_id"], first["key"]) if first else None, segment_bytes, date)
                put(0, whole)
                for data in more:
                    put(1, data)
        for s in streams:
            if s is not None:
                s.close()
        done = [k for k in (0, 1) if streams[k] is not None]
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{names[k]}" for k in done], pa.string()), pa.array([sizes[k] for k in done], pa.int64())], ["path", "bytes"])

    return written(rows.mapInArrow(run, "path string, bytes long"), "archives")


class _Readable:
    """A stream that ends where it is damaged: what follows in the archive is lost, what came before is not."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.left, self.broken = stream, b"", False

    def _more(self) -> bool:
        if self.broken:
            return False
        try:
            more = self.stream.read1(1 << 16)
        except (EOFError, OSError, zlib.error):
            more, self.broken = b"", True
        self.left += more
        return bool(more)

    def readline(self) -> bytes:
        while (end := self.left.find(b"\n") + 1) == 0 and self._more():
            pass
        end = end or len(self.left)
        out, self.left = self.left[:end], self.left[end:]
        return out

    def read(self, size: int) -> bytes:
        parts, left = [], size
        while left > 0 and (self.left or self._more()):
            parts.append(self.left[:left])
            self.left = self.left[left:]
            left -= len(parts[-1])
        return b"".join(parts)


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Headers (names in lower case), block, and whether it is complete, of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            if m := _NAME.match(line):
                head[m[1].decode("latin-1").lower()] = m[2].strip().decode("utf-8", "replace")
        length = head.get("content-length", "")
        size = int(length) if length.isdigit() else 0
        block = stream.read(size)
        yield head, block, length.isdigit() and len(block) == size
        if len(block) < size:
            return


_RECORD = "kind string, record_id string, origin string, uri string, digest string, refers_to string, segment int, total long, block binary, whole boolean"
_READ = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("origin", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("whole", pa.bool_())])


def _batches(rows: Iterable[tuple], schema: pa.Schema, size_of: int) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[size_of] or b"") + 200
        if size > OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def records(archives: DataFrame, segmented: bool | None = None) -> DataFrame:
    """The records of archives (path); of segmented records only, of others only, or all. An archive is read as a stream."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block, whole in parse(_Readable(stream)):
                        number = head.get("warc-segment-number", "")
                        if segmented is not None and segmented != bool(number):
                            continue
                        get = lambda name: head[name].strip("<>") if name in head else None  # noqa: B023, E731
                        total = head.get("warc-segment-total-length", "")
                        yield (head.get("warc-type"), get("warc-record-id"), get("warc-segment-origin-id") or get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-payload-digest"), get("warc-refers-to"), int(number) if number.isdigit() else None, int(total) if total.isdigit() else None, block, whole)

    return archives.select("path").mapInArrow(lambda batches: _batches(rows(batches), _READ, 8), _RECORD)


def reassembled(parts: DataFrame) -> DataFrame:
    """Segmented records put together: dealt by origin, in order of segment number; each in turn is held alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and row[2] != group[0][2]:
                    yield joined(group)
                    group = []
                if not (group and row[6] == group[-1][6] and row[8] == group[-1][8]):  # the same segment twice
                    group.append(row)
        if group:
            yield joined(group)

    def joined(group: list[tuple]) -> tuple:
        first, last = group[0], group[-1]
        block = b"".join(r[8] for r in group)
        good = [r[6] for r in group] == list(range(1, len(group) + 1)) and last[7] == len(block) and all(r[9] for r in group)
        return (first[0], first[1] if first[6] == 1 else first[2], first[2], first[3], first[4], first[5], 1, last[7], block, good)

    return parts.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(lambda batches: _batches(rows(batches), _READ, 8), _RECORD)


_PAGE = "page_id long, record_type string, uri string, refers_to long, payload_bytes long, payload_digest string, status string"


def decoded(records: DataFrame, payload: bool = True) -> DataFrame:
    """Per response or revisit: page_id, record_type, uri, refers_to, payload_bytes and payload_digest of the full payload, status and, if asked for, the payload (null for revisits)."""
    fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("status", pa.string())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payload)

    def number(urn: str | None) -> int | None:
        m = re.match(rf"{_URN}(-?\d+):", urn or "")
        return int(m[1]) if m else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for kind, record_id, _, uri, digest, refers_to, _, _, block, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                head, _, body = block.partition(b"\r\n\r\n")
                http = {k.lower(): v for k, v in _NAME.findall(head)}
                status, data, size = "ok" if whole else "incomplete", None, None
                named = (digest or "").removeprefix("sha1:")
                if kind == "revisit":
                    length = http.get(b"content-length", b"").strip()
                    size = int(length) if length.isdigit() else None
                elif whole:
                    data = unchunked(body) if http.get(b"transfer-encoding", b"").strip().lower() == b"chunked" else body
                    if data is None:
                        status = "bad chunk"
                    else:
                        size = len(data)
                        if named and sha1_base32(data) != named:
                            status = "bad digest"
                own = named or (sha1_base32(data) if data is not None else None)
                yield (number(record_id), kind, uri, number(refers_to), size, own, status, *[data] * payload)

    return records.where(F.col("kind").isin("response", "revisit", "continuation")).mapInArrow(lambda batches: _batches(rows(batches), schema, 7 if payload else 5), _PAGE + ", payload binary" * payload)


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Whole records are decoded where they are read; only segments are shuffled."""
    n = archives.count()
    spread = archives.select("path").repartitionByRange(max(1, n), "path")
    return decoded(records(spread, segmented=False), payload).unionByName(decoded(reassembled(records(spread, segmented=True)), payload))


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages), payload=False)
