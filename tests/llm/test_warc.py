from __future__ import annotations

import gzip
import hashlib
import io

import pytest

from helpers import by_id
from ledgerloom.llm import warc as op

SCHEMA = "page_id long, url string, html string, digest string, first long, payload string, n int"
LONG = "<p>é</p>" * 40


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y", 2) for i, u, h in rows], SCHEMA)


ROWS = [
    (5, "http://a/5", LONG),
    (3, "http://a/3?x=1 2", LONG),
    (9, None, LONG),
    (None, "http://a/n", LONG),
    (3, "http://a/3", LONG),
    (10, "http://a/\r\nX: y", "short"),
    (11, "http://a/11", "short"),
    (12, "http://a/12", None),
    (13, "http://a/13", ""),
    (14, "ü", "\r\n\r\n" + "z" * 200000),
    (None, None, "q" * 100),
    (None, None, "q" * 100),
    (20, "u", "w" * 99),
    (21, "u", "w" * 99),
]


def plain(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    found = []
    for i, _, h in rows:
        data = (h or "").encode()
        other = first.get(h or "")
        revisit = len(data) >= 100 and other is not None and other != i
        found.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(found, key=repr)


def test_round_trip(spark):
    found = op.round_trip(pages(spark, ROWS)).collect()
    assert by_id(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == plain(ROWS)
    assert op.round_trip(pages(spark, ROWS).limit(0)).count() == 0


def test_archives_on_disk(spark, tmp_path):
    archives = op.write_archives(pages(spark, ROWS).coalesce(1), f"file://{tmp_path}", archive=1000)
    names = sorted(p.name for p in tmp_path.iterdir())
    assert len(names) == archives.count() > 1
    assert not any(n.endswith(".draft") for n in names)
    payloads = []
    for path in sorted(tmp_path.glob("*.gz")):
        raw = path.read_bytes()
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")
        payloads += [r.payload.decode() for r in op.records(io.BytesIO(raw), 7) if r.headers["warc-type"] == "response"]
    assert "\r\n\r\n" + "z" * 200000 in payloads
    assert payloads.count("short") == 2


def test_reader_takes_pieces_of_any_size():
    data = b"".join(op.member(k, f"u{k}", bytes([65 + k]) * k * 50) for k in range(6))
    for piece in (1, 2, 13, 1 << 20):
        found = list(op.records(io.BytesIO(data), piece))
        assert [r.payload for r in found] == [bytes([65 + k]) * k * 50 for k in range(6)]
        assert [r.http["content-length"] for r in found] == [str(k * 50) for k in range(6)]
    assert list(op.records(io.BytesIO(b""))) == []


def test_broken_archives():
    good = op.member(1, "u", b"payload")
    with pytest.raises(op.WarcError):
        list(op.records(io.BytesIO(good[:-9])))
    plain = gzip.decompress(good)
    for bad in (plain.replace(b"payload", b"pAyload"), plain.replace(b"WARC/1.1", b"XARC/1.1"), plain + b"x", plain[:-1], plain.replace(b"Content-Length: 7", b"Content-Length: 8", 1), plain.replace(b"\r\nContent-Length", b"\r\nX-Length")):
        with pytest.raises(op.WarcError):
            list(op.records(io.BytesIO(gzip.compress(bad))))


def test_large_records(spark):
    html = ["é" * 3_000_000, "<p>" * 2_000_000, "é" * 3_000_000]
    pages = spark.createDataFrame([(k, f"http://x/{k}", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in op.round_trip(pages).collect()}
    assert [found[k]["payload_bytes"] for k in range(3)] == [6_000_000, 6_000_000, 6_000_000]
    assert [found[k]["record_type"] for k in range(3)] == ["response", "response", "revisit"]
    assert found[2]["refers_to"] == 0
