"""Minimum bin slack: pack token pieces into windows with as little padding as can be.

Documents are tokenized and cut at multiples of the capacity; a full piece fills
a window alone.  The rest of the plan needs only the histogram of the remaining
lengths, one row per length however large the corpus is.  For each window, the
longest length left is the seed, and a bitset subset-sum over the multiset of
lengths left finds the filling nearest to capacity; a filling is repeated as
often as the counts allow.  Pieces take the places of their length by rank, and
ranks come from prefix sums over hash buckets, so a length that a third of all
pieces have is dealt over many tasks.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .rolling import text_slices

CAPACITY = 2048
#: The id that ends every document.
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Buckets in which the pieces of one length are ranked.
RANK_BUCKETS = 1024
#: Segments that a Python worker remembers in each of two generations, and the longest of them.
CACHE_WORDS, CACHE_BYTES = 100_000, 40
#: Bytes of text encoded at once; one longer text is encoded by itself.
ENCODE_BYTES = 4 << 20
_SPACE, _LETTER, _OTHER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER[:128] = True
_OTHER &= ~_SPACE & ~_LETTER
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _two_byte_letters() -> np.ndarray:
    """By both bytes, the characters of two bytes that are letters in every version of Unicode and stay one letter when composed and lower-cased."""
    out = np.zeros(1 << 16, bool)
    for c in map(chr, range(0x80, 0x800)):
        old = unicodedata.ucd_3_2_0.category(c)[0] == "L" == unicodedata.category(c)[0]
        if old and unicodedata.is_normalized("NFC", c) and len(c.lower()) == 1 and unicodedata.category(c.lower())[0] == "L":
            out[int.from_bytes(c.encode(), "big")] = True
    return out


_TWO = _two_byte_letters()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The segments of all texts of a slice as binary strings, and where each text's segments begin among them.

    The tokenizer's rules never look across white space, and a run of letters is
    a word of its own between other ASCII characters, but for an apostrophe
    before it.  Nothing is cut beside any other character, which may join what
    stands before it, nor in a text that may name a special token.  Capitals that
    nothing can join are lower-cased here already, so that fewer segments differ.
    """
    ink, letter, other = ~_SPACE[data], _LETTER[data], _OTHER[data]
    high = data >= 128
    if high.any():
        two = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] < 0xE0))
        two = two[_TWO[data[two].astype(np.int32) << 8 | data[two + 1]]]
        letter[two] = letter[two + 1] = True
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = (~ink[:-1]) | letter[:-1] & other[1:] | other[:-1] & (data[:-1] != 39) & letter[1:]
    lower = _UPPER[data]
    lower[:-1] &= ~high[1:]
    marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    for row in np.unique(np.searchsorted(offsets, marks, "right") - 1).tolist() if len(marks) else ():
        a, b = offsets[row], offsets[row + 1]
        start[a + 1 : b], lower[a:b] = ~ink[a : b - 1], False
    start[offsets] = True
    starts = np.flatnonzero(start[:-1] & ink)
    squeezed = np.concatenate(([0], np.cumsum(ink, dtype=np.int64)))
    at = np.append(squeezed[starts], squeezed[-1])
    folded = (data + lower.view(np.uint8) * np.uint8(32))[ink]
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(folded)])
    return made, np.searchsorted(starts, offsets)


class WordEncoder:
    """Token ids of texts, remembering the ids of segments.  Every distinct segment is encoded by the tokenizer itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.known, self.older = Tokenizer.from_file(path), {}, {}

    def lookup(self, segments: list[bytes]) -> list[bytes]:
        """The ids of distinct segments, each as little-endian numbers.  What neither generation of the memory has is encoded."""
        found = list(map(self.known.get, segments))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            found[i] = self.older.get(segments[i])
            if found[i] is None:
                new.append(i)
        encoded = self.model.encode_batch_fast([segments[i].decode("utf-8", "surrogatepass") for i in new], add_special_tokens=False)
        for i, e in zip(new, encoded):
            found[i] = pack_ids(e.ids)
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        self.known.update((segments[i], found[i]) for i in missing if len(segments[i]) <= CACHE_BYTES)
        return found

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, each with the end id, and where each text's ids begin."""
        made, at = segments(data, offsets)
        coded = made.dictionary_encode()
        ids = [*self.lookup(coded.dictionary.to_pylist()), pack_ids([END_ID])]
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        codes = np.insert(coded.indices.to_numpy(), at[1:], len(ids) - 1)
        count = size[codes]
        ends = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        first = np.cumsum(size, dtype=np.int64) - size
        # places fit 32 bits but for a single text of some GB
        kind = np.int32 if max(ends[-1], first[-1]) < 1 << 31 else np.int64
        place = np.repeat((first[codes] - ends[:-1]).astype(kind), count)
        place += np.arange(ends[-1], dtype=kind)
        out = np.frombuffer(b"".join(ids), "<u4")[place]
        return out, ends[at + np.arange(len(at))]


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest length left and the multiset of others that with it comes nearest to ``capacity``."""
    seed = max(counts)
    target = capacity - seed
    mask, bits, steps = (1 << (target + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= target), reverse=True):
        left, k = min(counts[length] - (length == seed), target // length), 1
        while left > 0 and not bits >> target & 1:
            k = min(k, left)
            steps.append((length, k, bits))
            bits |= bits << (length * k) & mask
            left, k = left - k, k * 2
    taken, at = {seed: 1}, bits.bit_length() - 1
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + k
            at -= length * k
    return taken


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[str, np.ndarray], int]:
    """Places for every piece shorter than the capacity: by length and rank, the window, and how many windows there are."""
    counts = {x: n for x, n in histogram.items() if 0 < x < capacity and n > 0}
    used: dict[int, int] = dict.fromkeys(counts, 0)
    rows, windows = [], 0
    while counts:
        taken = fill(counts, capacity)
        times = min(counts[x] // k for x, k in taken.items())
        offset = 0
        for length in sorted(taken, reverse=True):
            k = taken[length]
            rows.append((length, used[length], windows, k, offset))
            offset += length * k
            used[length] += k * times
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
        windows += times
    rows.append((capacity, 0, windows, 1, 0))
    rows.sort()
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(("length", "rank", "window", "copies", "offset"))}, windows


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the document's id, the piece's start and length, the checksum of its ids and the document's tokens."""
    path = path or tokenizer_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        row, start, length, crc, total = [], [], [], [], []
        for first, _, data, offsets in text_slices(batch.column(1), ENCODE_BYTES):
            ids, at = enc.encode_slice(data, offsets)
            view = memoryview(ids.tobytes())
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()), first):
                for s in range(a, b, capacity):
                    m = min(capacity, b - s)
                    row.append(i), start.append(s - a), length.append(m), total.append(b - a)
                    crc.append(zlib.crc32(view[4 * s : 4 * (s + m)]))
        return pa.record_batch({id_col: batch.column(0).take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64())})

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Defined cases: a null or empty text has the end id alone; repeated rows are
    packed each; rows that agree in everything take their places in any order,
    which gives the same table; other columns are not read; an empty table gives
    an empty one.
    """
    pieces = token_pieces(docs, capacity, path, id_col, text_col)
    key = F.xxhash64(id_col, "start", "ids_crc32", "doc_tokens")
    pieces = materialize(pieces.withColumn("_key", key).withColumn("_bucket", F.pmod("_key", F.lit(RANK_BUCKETS))), "pieces")
    sums = pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan, _ = plan_windows(histogram, capacity)
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")
    inside = Window.partitionBy("length", "_bucket").orderBy("_key", id_col, "start", "ids_crc32", "doc_tokens")
    ranked = pieces.join(sums.select("length", "_bucket", before.alias("_before")), ["length", "_bucket"])
    ranked = ranked.select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("_before") + F.row_number().over(inside) - 1).cast("long").alias("_rank"))
    keys = (plan["length"] << 40) + plan["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            j = np.searchsorted(keys, (length << 40) + rank, "right") - 1
            local = rank - plan["rank"][j]
            sequence = plan["window"][j] + local // plan["copies"][j]
            offset = plan["offset"][j] + local % plan["copies"][j] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
