"""Repeated bytes against a dictionary of all 200-byte strings."""

import hashlib
import random
from collections import Counter

import pyarrow as pa

from tidewater.llm import suffixes


def brute(rows):
    datas = [(r.text or "").encode() for r in rows]
    times = Counter(d[i : i + 200] for d in datas for i in range(len(d) - 199))
    out = []
    for r, d in zip(rows, datas):
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if times[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((r.doc_id, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs):
    got = sorted(map(tuple, suffixes.cut_repeats(docs, keep_bytes=False).collect()), key=str)
    assert got == brute(docs.collect())


def test_documents(documents):
    check(documents.limit(120).select("doc_id", "text", "lang"))


def test_planted_passages(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop é") for _ in range(n))
    passage, other = word(330), word(205)
    rows = [(i, word(rng.randint(0, 400)) + passage[rng.randint(0, 40) : 300 + rng.randint(0, 30)] + word(rng.randint(0, 400))) for i in range(30)]
    rows += [(100 + i, word(30) + other + word(rng.randint(0, 5)) + other[: rng.randint(195, 205)]) for i in range(6)]
    rows += [(200, "x" * 900), (201, "ab" * 400), (202, "y" * 200), (203, "z" * 201), (204, passage), (204, passage), (None, passage[:250]), (205, None), (206, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_empty(empty_docs):
    assert suffixes.cut_repeats(empty_docs).count() == 0


def test_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefg ") for _ in range(3000))
    rows = [(1, text), (2, text[500:1900] + "!" + text[100:700]), (3, "q" * 2500), (4, text[1000:1300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(docs.collect())
    rest = [suffixes.segments(*x[2:]) for x in suffixes._parts(pa.array([text]))]
    monkeypatch.setattr(suffixes, "PART_BYTES", 256)
    parts = list(suffixes._parts(pa.array([text, "x"], pa.large_string())))
    assert sum(len(x[2]) - 199 for x in parts if len(x[2]) > 199) == 3000 - 199 and len(rest) == 1
    made = []
    for first, at, data, offsets in parts:
        s = suffixes.segments(data, offsets)
        made += [(at + a, at + b) for a, b in zip(s["start"].tolist(), s["end"].tolist())]
    assert sorted(i for a, b in made for i in range(a, b - 199)) == list(range(3000 - 199))
    got = sorted(map(tuple, suffixes.cut_repeats(docs, keep_bytes=False).collect()), key=str)
    assert got == want


def test_levels_of_the_index(spark):
    """Equal-sized levels merge, arrays are in order, positions lie in them, and a kept index takes another batch."""
    def batch(b):
        rows = [(b, k, k * 7, b << 20 | k) for k in range(-20, 20) if (k + b) % 3]
        return spark.createDataFrame(rows, "ref long, key long, seg long, place long")

    index = suffixes.SuffixIndex(spark, 4)
    ranks = []
    for b in range(5):
        index.add(batch(b))
        ranks.append(sorted(index.levels))
    assert ranks == [[0], [1], [0, 1], [2], [0, 2]]
    kept = suffixes.SuffixIndex(spark, 4, index.tables())
    kept.add(batch(5))
    assert sorted(kept.levels) == [1, 2]
    want = Counter((r.key, r.seg) for b in range(6) for r in batch(b).collect())
    files = {f.split("/")[-1] for t in kept.levels.values() for f in t.inputFiles()}
    for f in (f for t in kept.levels.values() for f in t.inputFiles()):
        keys = [(r.key, r.seg) for r in spark.read.parquet(f).collect()]
        assert keys == sorted(keys)
    assert files
    top = kept.all().collect()
    assert {(r.key, r.seg): r.n for r in top} == want and all(r.place & 0xFFFFF == r.key & 0xFFFFF for r in top)
    assert {(r.key, r.seg) for m in (index, kept) for r in m.repeated().collect()} == {k for k, n in want.items() if n > 1}
    kept.close()
    assert not spark.sql("SHOW TABLES").filter("tableName like 'suffixes%'").count()
