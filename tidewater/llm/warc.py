"""WARC archives written and read as tables of chunks.

Writing: every page becomes a record, or, when its payload is longer than
``CHUNK_BYTES``, a row for each chunk: the first is the record itself, the others
its continuation records (record identifier and segment number), so no row of the
output holds a whole oversized record.  A payload that repeats is stored once; the
other pages get revisit records that name the page that has it.  Archives are
written by Spark's text sink, whose line end is the one that closes a record, to
any file system, with at most ``FILE_RECORDS`` rows a file.

Reading: a file is unpacked and cut into records piece by piece.  What it gives is
a table of chunks keyed by record identifier and chunk number.  A record that lies
whole in one file has its SHA-1 carried from piece to piece while it is read; the
segments of the others are brought together by identifier and digested in order,
one after the other, as they stream by.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir

#: Payload bytes of one segment; a longer payload is written in several.
CHUNK_BYTES = 64 << 10
#: Rows of one archive, which so stays below 128 MB before compression.
FILE_RECORDS = 2048
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 0
#: A payload that one page in so many has is joined by broadcast; there are at most as many of them.
HOT_SHARE = 1000
#: Bytes unpacked at once, and chunks of one Arrow batch.
PIECE_BYTES, BATCH_CHUNKS = 1 << 20, 64
#: The longest head of a record or of its HTTP message.
HEAD_BYTES = 1 << 20

# Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "application/http; msgtype=response"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """The base32 form of 40 hex digits; five of them are four letters."""

    def letter(i: Column) -> Column:
        twenty_bits = F.conv(F.substring(digest, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.substring(F.lit(_BASE32), F.call_function("shiftright", twenty_bits, 15 - 5 * (i % 4)).bitwiseAND(31) + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines, each with its end; those of a null value are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in pairs])


def keyed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, url, payload, key): null pages are empty; equal keys, SHA-256, are equal payloads."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("key", F.unhex(F.sha2("payload", 256)))


def with_holder(rows: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``rows`` of :func:`keyed` with ``holder``, the page that stores the payload; null where the row itself does.

    Only payloads that repeat are looked up.  Those that ``1 / HOT_SHARE`` of all
    rows have, at most ``HOT_SHARE`` payloads, are broadcast, so no key of the
    other join holds more.
    """
    groups = rows.filter(F.length("payload") >= least).groupBy("key").agg(F.max("page").alias("holder"), F.count(F.lit(1)).alias("rows"))
    repeated = materialize(groups.filter("rows > 1"), "repeated")
    n = rows.count()
    hot = repeated.filter(F.col("rows") * HOT_SHARE >= n).select("key", F.col("holder").alias("hot"), F.lit(True).alias("is_hot"))
    cool = repeated.filter(F.col("rows") * HOT_SHARE < n).select(F.col("key").alias("cool_key"), F.col("holder").alias("cool"))
    found = rows.join(F.broadcast(hot), "key", "left")
    # Rows that are done, and so need no partner, are dealt by their page.
    found = found.withColumn("look_up", F.when(F.col("is_hot"), F.unhex(F.md5(F.coalesce(F.col("page").cast("string"), F.lit("")).cast("binary")))).otherwise(F.col("key")))
    found = found.join(cool, F.col("look_up") == F.col("cool_key"), "left")
    holder = F.when(F.col("is_hot"), F.col("hot")).otherwise(F.col("cool"))
    return found.select("page", "url", "payload", F.when(~holder.eqNullSafe(F.col("page")), holder).alias("holder"))


def record_rows(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``value``, the bytes of one record each but for its last line end, for rows of :func:`with_holder`."""
    size = F.length("payload")
    digest = base32_of_hex(F.sha1("payload"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    rows = rows.select("page", "holder", "payload", url.alias("url"), digest.alias("digest"), size.cast("long").alias("size"))
    name = lambda page: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    last = F.when(F.col("holder").isNotNull() | (F.col("size") == 0), 0).otherwise(F.floor((F.col("size") - 1) / chunk_bytes)).cast("int")
    rows = rows.withColumns({"name": name(F.col("page")), "refers": F.when(F.col("holder").isNotNull(), name(F.col("holder"))), "http": http, "last": last})
    rows = rows.withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("last"))))
    first, stored = F.col("segment") == 0, F.col("holder").isNull()
    part = F.when(stored, F.substring(F.col("payload"), F.col("segment") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit(b""))
    block = F.concat(F.when(first, F.col("http")).otherwise("").cast("binary"), part)
    rows = rows.withColumn("block", block)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _lines(
            ("WARC-Type", F.when(~first, "continuation").when(stored, "response").otherwise("revisit")),
            ("WARC-Record-ID", F.when(first, F.col("name")).otherwise(F.concat(F.rtrim(F.col("name"), F.lit(">")), F.lit(":"), (F.col("segment") + 1).cast("string"), F.lit(">")))),
            ("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
            ("WARC-Profile", F.when(~stored, _PROFILE)),
            ("WARC-Refers-To", F.col("refers")),
            ("WARC-Segment-Number", F.when(F.col("last") > 0, (F.col("segment") + 1).cast("string"))),
            ("WARC-Segment-Origin-ID", F.when(~first, F.col("name"))),
            ("WARC-Segment-Total-Length", F.when(~first & (F.col("segment") == F.col("last")), (F.length("http") + F.col("size")).cast("string"))),
            ("Content-Type", F.when(first, _HTTP)),
            ("Content-Length", F.length("block").cast("string")),
        ),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head.cast("binary"), F.col("block"), F.lit(b"\r\n")).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, least: int = REVISIT_BYTES, file_records: int = FILE_RECORDS, **columns: str) -> None:
    """Write a record for every page to gzipped archives in the new folder ``path``.

    Defined cases: a null page is empty; a null URL has no header line; white
    space and controls in a URL are written as ``%20``; null ids are written as no
    digits and are the last to hold a payload; rows that repeat an id and a payload
    are records alike, and where that page holds the payload, all of them store it;
    an empty table gives no record; other columns are ignored, whatever their names.
    """
    rows = record_rows(with_holder(keyed(pages, **columns), least), chunk_bytes)
    rows.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def unpacked(content: memoryview) -> Iterator[bytes]:
    """The bytes of an archive, gzipped whole or record by record or not at all, in pieces."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for at in range(0, len(content), PIECE_BYTES):
            yield bytes(content[at : at + PIECE_BYTES])
        return
    at, fed, unzip, full = 0, b"", zlib.decompressobj(31), False
    while fed or full or at < len(content):
        if not fed and not full:
            fed, at = bytes(content[at : at + PIECE_BYTES]), at + PIECE_BYTES
        piece = unzip.decompress(fed, PIECE_BYTES)
        full = len(piece) == PIECE_BYTES
        fed = unzip.unconsumed_tail
        if piece:
            yield piece
        if unzip.eof:
            fed, full, unzip = unzip.unused_data.lstrip(b"\0"), False, zlib.decompressobj(31)
            begun = bool(fed)
        else:
            begun = True
    if begun:
        raise ValueError("a gzipped archive ends inside a member")


class Bytes:
    """A stream of pieces, of which no more is held than what is asked for next."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        piece = next(self.pieces, b"")
        self.held += piece
        return bool(piece)

    def head(self, most: int = HEAD_BYTES) -> bytes | None:
        """What stands before the next empty line, or None at the end of the stream."""
        self.held = self.held.lstrip(b"\r\n")
        while not self.held:
            if not self.more():
                return None
            self.held = self.held.lstrip(b"\r\n")
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) > most or not self.more():
                raise ValueError(f"no end of a record's head: {self.held[:80]!r}")
        out, self.held = self.held[:end], self.held[end + 4 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes."""
        while n:
            if not self.held and not self.more():
                raise ValueError(f"an archive ends {n} bytes before its record does")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


class Chunk(NamedTuple):
    record_id: str
    segment: int
    chunk: int
    record_type: str | None
    target_uri: str | None
    refers_to: str | None
    stated_bytes: int | None
    stated_digest: str | None
    data: bytes | None
    n_bytes: int | None
    digest: str | None


CHUNK_SCHEMA = "record_id string, segment int, chunk int, record_type string, target_uri string, refers_to string, stated_bytes long, stated_digest string, data binary, n_bytes long, digest string"
_CHUNK_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string()]


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a head, by their names in lower case."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _message(block: Iterator[bytes]) -> tuple[dict[str, str], Iterator[bytes]]:
    """The fields of an HTTP message and the pieces of its body."""
    held = b""
    for piece in block:
        held += piece
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            return fields(held[:end]), _joined(held[end + 4 :], block)
        if len(held) > HEAD_BYTES:
            break
    return {}, _joined(held, block)  # no such message: all of it is payload


def _joined(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _sized(pieces: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The same bytes in chunks of ``size``, but for the last; at least one, if empty."""
    held, given = b"", False
    for piece in pieces:
        held += piece
        while len(held) > size:
            yield held[:size]
            held, given = held[size:], True
    if held or not given:
        yield held


def chunks_of(content: memoryview, chunk_bytes: int = CHUNK_BYTES, keep_data: bool = True) -> Iterator[Chunk]:
    """The chunks of an archive's response, revisit, resource and continuation records.

    The last chunk of a record that isn't segmented has its bytes and digest.
    Without ``keep_data`` such a record is that chunk alone, without data.
    """
    stream = Bytes(unpacked(content))
    while (head := stream.head()) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[:80]!r}")
        named = fields(head)
        kind, segment = named.get("warc-type"), int(named.get("warc-segment-number", 0))
        block = stream.take(int(named["content-length"]))
        if kind not in ("response", "revisit", "resource", "continuation"):
            for _ in block:
                pass
            continue
        http: dict[str, str] = {}
        if named.get("content-type", "").startswith("application/http"):
            http, block = _message(block)
        record = named.get("warc-segment-origin-id") or named["warc-record-id"]
        length = http.get("content-length", "")
        told = (kind, named.get("warc-target-uri"), (named.get("warc-refers-to") or "").strip("<>") or None, int(length) if length.isdigit() else None, named.get("warc-payload-digest", "").removeprefix("sha1:") or None)
        sha1, total, last, number = hashlib.sha1(), 0, None, -1
        for number, data in enumerate(_sized(block, chunk_bytes)):
            if last is not None and (keep_data or segment):
                yield Chunk(record.strip("<>"), segment, number - 1, *told, last, None, None)
            sha1.update(data)
            total, last = total + len(data), data
        whole = (None, None) if segment else (total, base32(sha1.digest()))
        yield Chunk(record.strip("<>"), segment, number, *told, last if keep_data or segment else None, *whole)


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, keep_data: bool = True) -> DataFrame:
    """The chunks (:class:`Chunk`) of all archives in ``path``, keyed by record identifier, segment and chunk number."""

    def rows(found: list[Chunk]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _CHUNK_TYPES)], names=list(Chunk._fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found: list[Chunk] = []
                for chunk in chunks_of(memoryview(content.as_buffer()), chunk_bytes, keep_data):
                    found.append(chunk)
                    if len(found) == BATCH_CHUNKS:
                        yield rows(found)
                        found = []
                if found:
                    yield rows(found)

    return spark.read.format("binaryFile").load(path).filter("length > 0").select("content").mapInArrow(run, CHUNK_SCHEMA)


_RECORD = ("record_id", "record_type", "target_uri", "refers_to", "stated_bytes", "stated_digest")
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, stated_bytes long, stated_digest string, payload_bytes long, payload_digest string"


def records(chunks: DataFrame) -> DataFrame:
    """A row for every record of :func:`read_chunks`, with the bytes and digest of its whole payload.

    A revisit stores no payload: its bytes and digest are those it states.  Chunks
    of one record stream by in order and leave only the state of its digest behind.
    Records with one identifier are one record's copies; each is returned.
    """
    laid = chunks.repartition(F.col("record_id")).sortWithinPartitions("record_id", "segment", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        open_id = place = told = None
        sha1, total, copies = hashlib.sha1(), 0, 0

        def close() -> None:
            if told is not None:
                found.extend([(*told, total, base32(sha1.digest()))] * copies)

        def made() -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=[*_RECORD, "payload_bytes", "payload_digest"])
            found.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if row["digest"] is not None:
                    stated = row["record_type"] == "revisit"
                    found.append((*[row[c] for c in _RECORD], row["stated_bytes"] if stated else row["n_bytes"], row["stated_digest"] if stated else row["digest"]))
                elif row["segment"]:
                    if row["record_id"] != open_id:
                        close()
                        open_id, place, told, sha1, total, copies = row["record_id"], None, [row[c] for c in _RECORD], hashlib.sha1(), 0, 0
                        first = (row["segment"], row["chunk"])
                    copies += (row["segment"], row["chunk"]) == first
                    if (row["segment"], row["chunk"]) != place:
                        place = (row["segment"], row["chunk"])
                        sha1.update(row["data"])
                        total += len(row["data"])
            if len(found) >= 1000:
                yield made()
        close()
        if found:
            yield made()

    return laid.mapInArrow(run, RECORD_SCHEMA)


def page_of(record_id: Column) -> Column:
    """The page in an identifier that :func:`write_archives` made, or null."""
    return F.regexp_extract(record_id, r"^urn:x-page:(-?[0-9]+):", 1).try_cast("long")


def round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, least: int = REVISIT_BYTES, file_records: int = FILE_RECORDS) -> DataFrame:
    """Write ``pages`` to archives, read these back, and tell what was read of each page."""
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid4().hex}"
    write_archives(pages, path, chunk_bytes, least, file_records)
    read = records(read_chunks(spark, path, chunk_bytes, keep_data=False))
    found = materialize(read.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to")), "warc-rows")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return found


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS holder FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM h
"""
