"""Ranked search against a plain Python ranking of the same rows."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewater.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(items, docs, k=10):
    """Sorted (item, rank, doc, score); a document is a row."""
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(1 for c in counts if c), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    found = []
    for item, asked in wanted.items():
        scored = []
        for i, c in enumerate(counts):
            m = 10 + 90 * c.total() * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, docs[i][0] is None, docs[i][0] or 0, docs[i][0]))
        found += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(found, key=str)


def frames(spark, items, docs):
    a = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit("clash"))
    b = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("term", "row", "doc", "tf", "n", "shard", "items", "item", "score", "rank"):
        b = b.withColumn(name, F.lit("clash"))
    return a, b


def test_ranks_equal_a_plain_ranking(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Über", "über", "İx", "naïve", "Ünï", "x1", "X1", "日本"]
    docs = [(i, rng.choice([" ", ", ", "--", "\t\n"]).join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(0, 80)))) for i in range(300)]
    docs += [(None, "w1 w2 über"), (None, "w1 w2 über"), (7, docs[7][1]), (400, None), (401, ""), (402, "..."), (403, docs[7][1]), (404, "w3 " * 5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)] + [(1, "w5 X1"), (None, "über w1"), (50, None), (51, "absent"), (52, "?!")]
    want = plain(items, docs)
    for size in (256, 2):
        monkeypatch.setattr(lexical, "LIST_ITEMS", size)
        got = [tuple(r) for r in lexical.search(*frames(spark, items, docs)).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got, key=str) == want
    assert {r[0] for r in want} >= {None, 1} and not {r[0] for r in want} & {50, 51, 52}


def test_terms_are_split_and_lowered_alike_in_parts(monkeypatch):
    text = "ABC dEf\x00é_Éa~x\x7fÀb 1a-2B ﬁ z"
    whole = Counter(t.encode() for t in terms(text))
    assert lexical.term_counts(text.encode()) == whole
    monkeypatch.setattr(lexical, "PART_BYTES", 3)
    assert lexical.term_counts(text.encode()) == whole


def test_empty_tables(spark):
    items, docs = frames(spark, [(1, "a b")], [(1, "a"), (2, "b b")])
    assert lexical.search(items, docs.limit(0)).count() == 0 == lexical.search(items.limit(0), docs).count()
    assert lexical.search(items, docs).count() == 2


def test_shards_follow_the_documents():
    assert lexical.shard_count(0) == lexical.LEAST_SHARDS and lexical.shard_count(10**9) == 10**9 // lexical.SHARD_DOCS
