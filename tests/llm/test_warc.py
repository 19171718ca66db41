import base64
import gzip
import hashlib
import io

import pytest

from pulsegrid.llm import warc

LONG = "<p>é😀</p>" * 9000
PAGES = [(1, "http://a/1", "<html>x</html>"), (2, "http://a/2?q=ü v\r\nX: y", LONG), (3, None, None), (4, "u", ""), (5, "u", LONG), (6, "u", LONG), (7, "u", "<html>x</html>"), (7, "u", "<html>x</html>"), (None, "u", "no id"), (9, "u", "a\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n"), (None, "u", "no id"), (10, "u", "z" * 8192)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "extra", b"k") for r in rows], "page_id long, url string, html string, key string, digest binary").repartition(3)


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


@pytest.mark.parametrize("segment", [100, 8192, 1 << 30])
def test_round_trip(spark, segment):
    got = warc.read_archives(warc.write_archives(pages(spark), segment_bytes=segment)).collect()
    assert len(got) == len(PAGES) and {r.status for r in got} == {"ok"}
    groups = {}
    for i, _, t in PAGES:
        groups.setdefault(t or "", []).append(i)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(i), len((t or "").encode()), digest(t)) for i, _, t in PAGES)
    for t, ids in groups.items():
        own = [r for r in got if r.payload_digest == digest(t)]
        first = [r for r in own if r.record_type == "response"]
        top = max((i for i in ids if i is not None), default=None)
        assert [(r.page_id, bytes(r.payload), r.refers_to) for r in first] == [(top, t.encode(), None)]
        assert all(r.record_type == "revisit" and r.refers_to == top and r.payload is None for r in own if r is not first[0])


def test_small_payloads_are_all_responses(spark):
    got = warc.read_archives(warc.write_archives(pages(spark), min_bytes=1000), payload=False).collect()
    assert sorted(str(r.page_id) for r in got if r.record_type == "revisit") == ["2", "5"]


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []))).collect() == []


def test_records_follow_the_format(spark, tmp_path):
    paths = [r.path for r in warc.write_archives(pages(spark), folder=str(tmp_path), segment_bytes=1000).collect()]
    heads = [h for p in paths for h, _, whole in warc.parse(io.BytesIO(gzip.open(p).read())) if whole]
    assert sum(h["warc-type"] == "warcinfo" for h in heads) == len(paths)
    parts = [h for h in heads if h["warc-type"] == "continuation"]
    assert parts and all(int(h["warc-segment-number"]) >= 2 and h["warc-segment-origin-id"] for h in parts)
    assert len({h["warc-record-id"] for h in heads}) == len(heads)


def segments(spark, rows):
    full = [("response" if s == 1 else "continuation", f"{warc._URN}1:0:{s}" if s != 1 else f"{warc._URN}1:0", f"{warc._URN}1:0", None, None, None, s, t, b, True) for s, t, b in rows]
    return spark.createDataFrame(full, warc._RECORD)


@pytest.mark.parametrize(("rows", "status"), [
    ([(2, None, b"ed\r\n\r\n2\r\nab\r\n"), (1, None, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunk"), (3, 63, b"0\r\n\r\n")], "incomplete"),
    ([(2, None, b"ed\r\n\r\n2\r\nab\r\n"), (1, None, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunk"), (3, 59, b"0\r\n\r\n"), (2, None, b"ed\r\n\r\n2\r\nab\r\n")], "ok"),
    ([(1, None, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunk"), (3, 59, b"0\r\n\r\n")], "incomplete"),
    ([(1, None, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunk"), (2, 52, b"ed\r\n\r\nzz\r\n\r\n"[:11])], "bad chunk"),
])
def test_reassembly_checks_order_and_length(spark, rows, status):
    got = warc.decoded(warc.reassembled(segments(spark, rows))).collect()
    assert [r.status for r in got] == [status]
    if status == "ok":
        assert bytes(got[0].payload) == b"ab"


def test_chunks():
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        data = bytes(range(256)) * (n // 256 + 1)
        assert warc.unchunked(warc.chunked(data[:n])) == data[:n]
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"") is None and warc.unchunked(b"-1\r\n") is None


def test_damaged_archives_do_not_crash():
    good = gzip.decompress(warc.record("response", "urn:page:1:0", {}, b"abc"))
    assert [(b, w) for _, b, w in warc.parse(io.BytesIO(b"junk\r\n" + good + good[:-6]))] == [(b"abc", True), (b"a", False)]
    assert list(warc.parse(io.BytesIO(b""))) == []


@pytest.mark.parametrize("cut", [slice(0, -40), slice(0, 200), slice(0, 0)])
def test_a_cut_archive_gives_what_comes_before(spark, tmp_path, cut):
    rows = [(i, None, f"page {i} " * 30) for i in range(1, 6)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    path = archives.first().path.removeprefix("file:")
    whole = open(path, "rb").read()
    want = {r.page_id for r in warc.read_archives(archives).collect()}
    open(path, "wb").write(whole[cut])
    got = warc.read_archives(archives).collect()
    assert want == {1, 2, 3, 4, 5} and {r.page_id for r in got if r.status == "ok"} < want
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 255
    open(path, "wb").write(bytes(flipped))
    got = warc.read_archives(archives).collect()
    assert 1 in {r.page_id for r in got if r.status == "ok"} and len(got) <= 5
    assert all(bytes(r.payload).decode() == f"page {r.page_id} " * 30 for r in got if r.status == "ok")
