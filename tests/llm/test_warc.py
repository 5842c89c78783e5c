"""Archives written, read and digested against the pages they came from."""

import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewater.llm import warc


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows, least=0):
    """Sorted (page, bytes, digest, type, refers to)."""
    holder = {}
    for page, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least and p in holder:
            holder[p] = max(holder[p], page, key=lambda x: (x is not None, x or 0))
        elif len(p) >= least:
            holder[p] = page
    out = []
    for page, _, html in rows:
        p = (html or "").encode()
        own = holder.get(p, page) == page
        out.append((page, len(p), digest(p), "response" if own else "revisit", None if own else holder[p]))
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for name in ("page", "payload", "key", "holder", "hot", "value", "segment", "digest", "size", "block"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def pages():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("ab\r\n\r\n\0é日<>", k=n))
    rows = [(i, f"https://h.example.com/{i}", text(rng.randint(0, 400))) for i in range(40)]
    rows += [(100 + i, None, rows[3][2]) for i in range(30)] + [(200 + i, "x", "") for i in range(5)] + [(300, "bad\r\nurl: x", None), (None, "n", rows[3][2]), (None, "n", "alone")]
    rows += [(400, "big", "WARC/1.1\r\n\r\n" * 9000), (401, "twin", "é" * 3001), (401, "twin", "é" * 3001), (402, "twin", "other"), (402, "twin", "other yet"), (-5, "neg", "minus")]
    return rows


@pytest.mark.parametrize("chunk, least, records", [(warc.CHUNK_BYTES, 0, 2048), (7, 0, 5), (64, 6002, 1000)])
def test_round_trip(spark, chunk, least, records):
    got = warc.round_trip(frame(spark, pages()), chunk, least, records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages(), least)


def test_hot_payloads_are_looked_up_alike(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 4)
    got = warc.round_trip(frame(spark, pages()), 64).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages())


def test_chunks_give_the_payload_back(spark, tmp_path):
    rows = [(1, "u", "0123456789" * 10), (2, "v", "short"), (3, None, "")]
    warc.write_archives(frame(spark, rows), str(tmp_path / "a"), chunk_bytes=16)
    found = warc.read_chunks(spark, str(tmp_path / "a"), chunk_bytes=8).collect()
    assert all(len(r.data) <= 8 for r in found)
    made = {}
    for r in sorted(found, key=lambda r: (r.record_id, r.segment, r.chunk)):
        made[r.record_id] = made.get(r.record_id, b"") + bytes(r.data)
    assert sorted(made.values()) == sorted(h.encode() for _, _, h in rows)
    read = {r.target_uri: r for r in warc.records(warc.read_chunks(spark, str(tmp_path / "a"))).collect()}
    assert all(r.payload_digest == r.stated_digest and r.payload_bytes == r.stated_bytes for r in read.values())


def record(kind, name, block, *more):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"Content-Length: {len(block)}", *more]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    body = bytes(range(256)) * 5000
    made = [record("warcinfo", "urn:a", b"software: x\r\n"), record("resource", "urn:b", body, "WARC-Target-URI: http://b/", "Content-Type: image/png"), record("response", "urn:c", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody", "content-type: application/http; msgtype=response"), record("request", "urn:d", b"GET /")]
    os.makedirs(tmp_path / "w")
    (tmp_path / "w" / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    (tmp_path / "w" / "plain.warc").write_bytes(b"".join(made).replace(b"urn:", b"urn:plain:"))
    (tmp_path / "w" / "empty.warc").write_bytes(b"")
    got = {(r.record_id, r.payload_bytes, r.payload_digest) for r in warc.records(warc.read_chunks(spark, str(tmp_path / "w"))).collect()}
    assert got == {(f"urn:{p}{n}", len(b), digest(b)) for p in ("", "plain:") for n, b in (("b", body), ("c", b"body"))}


@pytest.mark.parametrize("data", [b"no archive at all\r\n\r\n", record("response", "urn:x", b"12345")[:-6], gzip.compress(record("response", "urn:x", b"12345" * 999))[:-20]])
def test_broken_archives_are_told(data):
    with pytest.raises(ValueError):
        list(warc.chunks_of(memoryview(data)))


def test_no_pages(spark):
    assert warc.round_trip(frame(spark, pages()).limit(0)).count() == 0


def test_unpacking_holds_little():
    zeros = gzip.compress(bytes(30 << 20)) + gzip.compress(b"end")
    pieces = list(warc.unpacked(memoryview(zeros)))
    assert max(map(len, pieces)) <= warc.PIECE_BYTES and b"".join(pieces) == bytes(30 << 20) + b"end"
