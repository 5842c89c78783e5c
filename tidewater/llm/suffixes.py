"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

Every string of ``LENGTH`` bytes has an anchor: where the smallest hash of a
``HEAD``-byte string inside it begins.  Equal strings have their anchors at equal
places, so only suffixes that begin at anchors are indexed, some 1 in 70.  The
strings that share an anchor form a *segment*, a run of overlapping windows.

New documents come in batches.  A batch's suffix array has an entry for every
different segment: the order key of its suffix (three bytes, then a fingerprint
of the first 32: whole heads would take more room than the input), a fingerprint
of the segment, and the position of one occurrence.  The array is scanned
against each level of the index for segments that both have, the long matches,
and then joins the index; two levels of one size are merged into one of double
the size, so a suffix is rewritten a number of times that grows with the
logarithm of the batches.  Arrays are bucketed and sorted alike, so scans and
merges read them side by side without a shuffle, and a head that a third of all
documents have is dealt over all buckets by its segments.

Segments that occur twice are repeated whole.  Those that share only their head
with another segment are compared by windows, read from the text at the noted
position: first by the common core of 16 neighbouring windows, then window by
window.  Equality is decided by 128 bits of hash, of which the order key is half
for whole segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, discard, map_arrow, materialize, materialize_bucketed, scratch_name
from .rolling import SLICE_BYTES, U64, Poly, mix, text_slices

LENGTH, HEAD = 200, 32
#: Windows whose common core is compared first.
BLOCK = 16
BATCHES = 4
#: A longer text is read in parts of so many bytes, which overlap by all but one byte of a window.
PART_BYTES = 4 << 20
_POS_BITS = 27
_A = Poly(101)
_SPREAD = U64(0x9E3779B97F4A7C15)


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of ranges of bytes, as two columns of 64 bits."""
    of = xxhash.xxh3_128_digest
    made = b"".join([of(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())])
    both = np.frombuffer(made, U64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    out, have = v, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, head: int = HEAD) -> dict[str, np.ndarray]:
    """The segments of all texts of a slice, in order: row, first window's start, anchor, end of the last window, and hashes."""
    n = len(data)
    names = ("row", "start", "anchor", "end", "key", "seg")
    if n < length or not (np.diff(offsets) >= length).any():
        return {k: np.zeros(0, np.int64) for k in names}
    sums = _A.sums(data)
    grams = _A.ranges(sums, np.arange(n - head + 1), np.arange(head, n + 1))
    v = ((grams * _SPREAD) >> U64(_POS_BITS) << U64(_POS_BITS)) | np.arange(len(grams), dtype=U64)
    least = _sliding_min(v, length - head + 1)
    ok = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(ok, offsets[long], 1)
    np.add.at(ok, offsets[long + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(ok[: len(least)]) > 0)
    anchors = (least[starts] & U64((1 << _POS_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    last = np.append(first[1:], len(starts)) - 1
    s1, end, a = starts[first], starts[last] + length, anchors[first]
    three = np.zeros(len(a), U64)
    for i in range(3):
        three = three << U64(8) | data[a + i].astype(U64)
    key = three << U64(40) | mix(grams[a]) >> U64(24)
    return {
        "row": np.searchsorted(offsets, s1, "right") - 1, "start": s1, "anchor": a, "end": end,
        "key": (key ^ U64(1 << 63)).view(np.int64), "seg": digests(data.tobytes(), s1, end)[0].view(np.int64),
    }


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as ``text_slices`` gives them, and long texts in overlapping parts: first row, start in the text, bytes, offsets."""
    # a slice of more bytes than the limit is one text
    for first, _, data, offsets in text_slices(column, min(SLICE_BYTES, PART_BYTES)):
        if len(data) <= PART_BYTES:
            yield first, 0, data, offsets
            continue
        for at in range(0, len(data) - LENGTH + 1, PART_BYTES):
            part = data[at : at + PART_BYTES + LENGTH - 1]
            yield first, at, part, np.array([0, len(part)])


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every document that has segments: its id, the hash of its text, and lists of order keys, fingerprints and places of its segments.

    A place is the start of a segment, the anchor's distance from it and its size in one number.
    """
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        made = []
        for first, at, data, offsets in _parts(batch.column(2)):
            s = segments(data, offsets)
            if len(s["row"]):
                start = s["start"] - offsets[s["row"]] + at
                made.append((s["row"] + first, s["key"], s["seg"], start << 20 | (s["anchor"] - s["start"]) << 10 | (s["end"] - s["start"])))
        if not made:
            return None
        row, *columns = (np.concatenate(x) for x in zip(*made))
        new = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        ends = pa.array(np.append(new, len(row)), pa.int32())
        rows = pa.array(row[new])
        return pa.table({"id": batch.column(0).take(rows), "h": batch.column(1).take(rows), **{n: pa.ListArray.from_arrays(ends, pa.array(c)) for n, c in zip(("key", "seg", "place"), columns)}})

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(named, run, f"id {kind}, h long, key array<long>, seg array<long>, place array<long>")


def _exploded(seen: DataFrame) -> DataFrame:
    """One row a segment: ``ref, key, seg, place``."""
    return seen.select("ref", F.explode(F.arrays_zip("key", "seg", "place")).alias("s")).select("ref", "s.key", "s.seg", "s.place")


class SuffixIndex:
    """Levels of suffix arrays ``key, seg, n, ref, place``, bucketed tables in the shared folder; level ``i`` holds ``2^i`` batches.

    ``ref`` is the caller's number of a document.  ``levels`` of an index kept
    from an earlier run can be given by the names of its tables, which
    :meth:`tables` tells.
    """

    def __init__(self, spark: SparkSession, buckets: int, levels: dict[int, str] | None = None):
        self.spark, self.buckets = spark, buckets
        self.levels = {rank: bucketed(spark, name) for rank, name in (levels or {}).items()}
        self.matches: list[DataFrame] = []

    def tables(self) -> dict[int, str]:
        return {rank: scratch_name(table) for rank, table in self.levels.items()}

    def add(self, batch: DataFrame) -> None:
        """Index a batch of segments ``key, seg, ref, place``; those that it has twice or shares with a level are noted in ``matches``."""
        array = self._keep(batch.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), F.first("ref").alias("ref"), F.first("place").alias("place")))
        found = array.filter("n > 1").select("key", "seg")
        for level in self.levels.values():
            found = found.unionByName(array.filter("n = 1").join(level.select("key", "seg"), ["key", "seg"]).select("key", "seg"))
        self.matches.append(materialize(found, "matches"))
        self._insert(array, 0)

    def _keep(self, rows: DataFrame) -> DataFrame:
        return materialize_bucketed(rows, "suffixes", ["key", "seg"], self.buckets)

    def _insert(self, array: DataFrame, rank: int) -> None:
        while rank in self.levels:
            older = self.levels.pop(rank)
            merged = self._merge(older, array)
            discard(older), discard(array)
            array, rank = merged, rank + 1
        self.levels[rank] = array

    def _merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        other = b.select("key", "seg", *[F.col(c).alias(f"_{c}") for c in ("n", "ref", "place")])
        both = a.join(other, ["key", "seg"], "full")
        total = (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n")
        return self._keep(both.select("key", "seg", total, F.coalesce("ref", "_ref").alias("ref"), F.coalesce("place", "_place").alias("place")))

    def all(self) -> DataFrame:
        """The whole index as one array; levels that are left are merged, smallest first."""
        while len(self.levels) > 1:
            low, high = sorted(self.levels)[:2]
            a, b = self.levels.pop(low), self.levels.pop(high)
            self.levels[high] = self._merge(a, b)
            discard(a), discard(b)
        return next(iter(self.levels.values()))

    def repeated(self) -> DataFrame:
        """``key, seg`` of segments that occur twice, by the scans so far."""
        out = self.matches[0]
        for x in self.matches[1:]:
            out = out.unionByName(x)
        return out.distinct()

    def close(self) -> None:
        """Delete the tables of all levels and matches."""
        for table in (*self.levels.values(), *self.matches):
            discard(table)
        self.levels, self.matches = {}, []


def _cut_out(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Bytes of the wanted segments (column ``wanted``) of each text."""
    out: dict[str, list] = {k: [] for k in ("key", "seg", "lead", "bytes")}
    for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
        data = (text.as_py() or "").encode("utf-8", "surrogatepass")
        for w in wanted:
            start, lead, size = w["place"] >> 20, w["place"] >> 10 & 1023, w["place"] & 1023
            for k, v in (("key", w["key"]), ("seg", w["seg"]), ("lead", lead), ("bytes", data[start : start + size])):
                out[k].append(v)
    return pa.record_batch({**{k: pa.array(out[k], pa.int64()) for k in ("key", "seg")}, "lead": pa.array(out["lead"], pa.int32()), "bytes": pa.array(out["bytes"], pa.binary())})


def _bytes_of(column: pa.Array) -> tuple[bytes, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, o, data = column.buffers()
    at = np.frombuffer(o, np.int64, len(column) + 1 + column.offset)[column.offset :]
    return (memoryview(data)[at[0] : at[-1]].tobytes() if len(column) and data is not None else b""), at - at[0]


def _block_rows(batch: pa.RecordBatch, length: int = LENGTH, block: int = BLOCK) -> pa.RecordBatch | None:
    """For every block of windows of every segment: its core's and its own fingerprint, and its windows' range in the segment."""
    if not batch.num_rows:
        return None
    data, base = _bytes_of(batch.column(3))
    lead, size = batch.column(2).to_numpy().astype(np.int64), np.diff(base)
    most, least = lead, lead - (size - length)  # the anchor's place in the first and in the last window
    count = most // block - least // block + 1
    seg = np.repeat(np.arange(len(size)), count)
    q = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(least // block, count)
    core = base[seg] + lead[seg] - block * q
    first, last = lead[seg] - np.minimum(most[seg], block * q + block - 1), lead[seg] - np.maximum(least[seg], block * q)
    tag = mix(batch.column(0).to_numpy().view(U64)[seg] + q.astype(U64) * _SPREAD)
    span = tag + ((first - lead[seg] + 4096).astype(U64) * U64(8192) + (last - first).astype(U64)) * _SPREAD
    ckey = mix(digests(data, core, core + length - block + 1)[0] + tag)
    u1, u2 = (mix(u + span) for u in digests(data, base[seg] + first, base[seg] + last + length))
    rows = pa.array(seg)
    return pa.record_batch({
        "key": batch.column(0).take(rows), "seg": batch.column(1).take(rows), "ckey": pa.array(ckey.view(np.int64)), "u1": pa.array(u1.view(np.int64)), "u2": pa.array(u2.view(np.int64)),
        "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32()),
    })


def _window_rows(batch: pa.RecordBatch, length: int = LENGTH) -> pa.RecordBatch | None:
    """Fingerprints of every window in the wanted blocks (``u1``, ``first``, ``last``, ``bytes``) and its place in the block."""
    if not batch.num_rows:
        return None
    data, base = _bytes_of(batch.column(3))
    first, last = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64)
    count = last - first + 1
    row = np.repeat(np.arange(len(count)), count)
    i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    s = base[row] + first[row] + i
    w1, w2 = digests(data, s, s + length)
    return pa.record_batch({"u1": batch.column(0).take(pa.array(row)), "i": pa.array(i, pa.int32()), "w1": pa.array(w1.view(np.int64)), "w2": pa.array(w2.view(np.int64))})


def _edges(index: DataFrame, seen: DataFrame) -> DataFrame:
    """``id, h, wanted``: by document, one occurrence of every segment that shares its head with a different one."""
    several = index.groupBy("key").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi")).filter("lo != hi").select("key")
    edge = index.select("key", "seg", "ref", "place").join(several, "key", "left_semi")
    wanted = edge.groupBy("ref").agg(F.collect_list(F.struct("key", "seg", "place")).alias("wanted"))  # at most a document's own segments
    return wanted.join(seen.select("ref", "id", "h"), "ref").select("id", "h", "wanted")


def _partly_repeated(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, seg, r)``: ranges of repeated windows in segments that share a head with a different segment.  Every step is a table that goes as soon as it has been read."""
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.col(text_col).alias("text"))
    joined = texts.join(wanted, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h"))).select("text", "wanted")
    cut = materialize(map_arrow(joined, _cut_out, "key long, seg long, lead int, bytes binary"), "edges")
    discard(wanted)
    blocks = materialize(map_arrow(cut, _block_rows, "key long, seg long, ckey long, u1 long, u2 long, first int, last int"), "blocks")
    twice = (F.min("seg") != F.max("seg")).alias("twice")
    unions = blocks.groupBy("ckey", "u1", "u2").agg(twice, *[F.first(c).alias(c) for c in ("first", "last", "key", "seg")])
    unions = materialize(unions.drop("u2"), "unions")
    open_ = unions.groupBy("ckey").agg(F.min("u1").alias("lo1"), F.max("u1").alias("hi1")).filter("lo1 != hi1").select("ckey")
    compare = unions.join(open_, "ckey", "left_semi").select("key", "seg", "u1", "first", "last")
    windows = materialize(map_arrow(compare.join(cut.dropDuplicates(["key", "seg"]), ["key", "seg"]).select("u1", "first", "last", "bytes"), _window_rows, "u1 long, i int, w1 long, w2 long"), "windows")
    discard(cut)
    again = windows.groupBy("w1", "w2").agg(F.min("u1").alias("lo"), F.max("u1").alias("hi")).filter("lo != hi").select("w1", "w2")
    run = F.transform(F.array_sort(F.collect_set("i")), lambda i: F.struct(i.alias("f"), i.alias("t")))  # at most BLOCK entries
    runs = materialize(windows.join(again, ["w1", "w2"], "left_semi").groupBy("u1").agg(run.alias("runs")), "runs")
    discard(windows)
    part = unions.filter("not twice").select("ckey", "u1").join(runs, "u1").select("ckey", "u1", "runs")
    all_of = unions.filter("twice").select("ckey", "u1", F.array(F.struct(F.lit(0).alias("f"), (F.col("last") - F.col("first")).alias("t"))).alias("runs"))
    found = blocks.select("key", "seg", "ckey", "u1", "first").join(all_of.unionByName(part), ["ckey", "u1"])
    ranges = found.select("key", "seg", F.col("first").alias("at"), F.explode("runs").alias("r")).select("key", "seg", (F.col("at") + F.col("r.f")).alias("first"), (F.col("at") + F.col("r.t")).alias("last"))
    each = materialize(ranges.groupBy("key", "seg").agg(F.collect_set(F.struct("first", "last")).alias("r")), "partly")  # at most a segment's windows
    for used in (blocks, unions, runs):
        discard(used)
    return each


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """``(id, h, spans)`` of documents with repeated bytes; spans may overlap, and each is one number, its start times 2^32 and its end.  ``h`` is the hash of the text."""
    spark = docs.sparkSession
    made = occurrences(docs, id_col, text_col).withColumn("ref", F.monotonically_increasing_id())
    seen = materialize(made.withColumn("batch", F.pmod(F.hash("ref"), F.lit(batches))), "segments", by="batch")
    index = SuffixIndex(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for b in range(batches):
        index.add(_exploded(seen.filter(F.col("batch") == b)))
    wanted = materialize(_edges(index.all(), seen), "wanted")
    whole = materialize(index.repeated().withColumn("whole", F.lit(True)), "whole")
    index.close()
    part = _partly_repeated(wanted, docs, id_col, text_col)
    marks = materialize(whole.join(part, ["key", "seg"], "full"), "marks")
    discard(whole), discard(part)
    span = lambda s, e: F.shiftleft(s, 32).bitwiseOR(e)
    start, size = F.shiftright("place", 20), F.col("place").bitwiseAND(1023)
    some = F.transform("r", lambda r: span(start + r["first"], start + r["last"] + LENGTH))
    here = _exploded(seen).join(marks, ["key", "seg"]).select("ref", F.when(F.col("whole"), F.array(span(start, start + size))).otherwise(some).alias("s"))
    spans = here.groupBy("ref").agg(F.flatten(F.collect_list("s")).alias("spans"))  # at most a document's own
    # equal rows have equal spans
    spans = materialize(spans.join(seen.select("ref", "id", "h"), "ref").select("id", "h", "spans").dropDuplicates(["id", "h"]), "spans")
    discard(seen), discard(marks)
    return spans


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, keep_bytes: bool = True) -> DataFrame:
    """Every document without the bytes that lie in a ``LENGTH``-byte string which also starts elsewhere.

    Returns per row ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and, if wanted, ``kept``, the remaining bytes.

    Defined cases: a null text is empty; very long texts are read in parts; texts shorter than ``LENGTH`` bytes keep
    all; repeated rows repeat each other; rows with one id are told apart by
    their texts; other columns are not read; an empty table gives an empty one.
    """
    spans = repeated_spans(docs, id_col, text_col, batches)
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"), F.col(text_col).alias("text"))
    joined = texts.join(spans, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h")), "left").select(F.col("_id").alias(id_col), "text", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        packed = batch.column(2)
        offsets, values = packed.offsets.to_numpy(), packed.values.to_numpy()
        for text, a, b in zip(batch.column(1), offsets[:-1].tolist(), offsets[1:].tolist()):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            kept, runs = data, 0
            if b > a:
                v = np.sort(values[a:b])
                s, e = v >> 32, np.maximum.accumulate(v & 0xFFFFFFFF)
                new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
                last = np.append(new[1:], len(v)) - 1
                edges = [0, *np.stack((s[new], e[last]), 1).ravel().tolist(), len(data)]
                kept, runs = b"".join([data[x:y] for x, y in zip(edges[::2], edges[1::2])]), len(new)
            for k, x in zip(out, (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None)):
                out[k].append(x)
        columns = {id_col: batch.column(0), **{k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}, "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        return pa.record_batch({**columns, "kept": pa.array(out["kept"], pa.binary())} if keep_bytes else columns)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(joined, run, f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes)
