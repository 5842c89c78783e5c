"""Personal data, quality rules, packing and mixing against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import mixing, packing, pii, quality


def base_pii(text):
    def luhn(s):
        t = 0
        for i, c in enumerate(reversed(s)):
            v = int(c) * (1 + i % 2)
            t += v - 9 if v > 9 else v
        return t % 10 == 0

    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


PERSONAL = [
    "mail a.b@c.de or x@y, 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8",
    "card 4337166598464399 or 4337-1665-9846-4399 or 4337 1665 9846 4398", "call +1 (988) 555-2485 now +49 30 1234567890123456",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and user [at] example [dot] org', "999.999.999.999 +1", "a@b.c" * 3, "é@é.é",
]


def test_pii_matches_the_base_rules(spark, documents):
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(PERSONAL)], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs, keep=["doc_id"])).collect()}
    for r in docs.collect():
        want, g = base_pii(r.text or ""), got[r.doc_id]
        n = Counter(x[2] for x in want)
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        spans = [f"{k}:{s}:{e}" for s, _, k, e in want]
        assert g.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(g.spans.split(",")) | {""}
    assert "secret:9:49" in got[10**6 + 3].spans


def test_pii_reliabilities_separate_good_from_bad_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.9, 0.85, 0.9, 0.6, 0.55]
    votes = np.zeros(4000, np.int64)
    for i, p in enumerate(right):
        said = np.where(rng.random(4000) < p, truth, ~truth)
        votes += (1 + said) * 3**i
    patterns, inverse, counts = np.unique(votes, return_inverse=True, return_counts=True)
    post = pii.reliabilities(np.zeros(len(patterns), np.int64), patterns, counts)
    assert ((post[inverse] > 0.5) == truth).mean() > 0.95


def test_redact_replaces_spans(spark):
    docs = spark.createDataFrame([(1, "write a.b@c.de today", "x"), (2, None, "y")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "write <email> today" and got[1].spans == "x" and got[2].text is None


def quality_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_counts(spark, documents, odd_docs):
    for docs in (documents, odd_docs):
        got = quality.quality_rules(docs).collect()
        assert len(got) == docs.count()
        for r in got:
            want = quality_counts(r.text or "")
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r.base_failed and r.kept)


def test_quality_keeps_clean_documents(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.quality_rules(documents).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert sum(good) >= 0.98 * len(good)


def test_jensen_shannon_distance():
    p = np.array([[1.0, 0], [0.5, 0.5]])
    d = quality.js_distance(p, p)
    assert d[0, 0] == 0 and 0 < d[0, 1] < 1 and quality.js_distance(p[:1], np.array([[0, 1.0]]))[0, 0] == pytest.approx(1)


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for doc_id, group in texts.items():
        want = Counter()
        for text in group:
            ids = model.encode(text or "", add_special_tokens=False).ids + [1]
            data = np.array(ids, "<u4").tobytes()
            for s in range(0, len(ids), 2048):
                part = data[4 * s : 4 * (s + 2048)]
                want[s, len(part) // 4, zlib.crc32(part), len(ids)] += 1
        assert want == Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id])
    total = 0
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    return total, len(by_seq)


def test_packing_keeps_every_token_and_pads_little(documents, odd_docs):
    for docs in (documents, odd_docs):
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(r.text)
        total, n = check_packing(packing.pack(docs).collect(), texts)
        assert n <= total // 2048 + 2


def test_fill_finds_the_best_sum():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = {int(x): int(k) for x, k in zip(rng.integers(1, 60, 5), rng.integers(1, 4, 5))}
        got = packing.fill(counts, 100)
        seed = max(counts)
        sums = {seed}
        for x, k in counts.items():
            for _ in range(k - (x == seed)):
                sums |= {s + x for s in sums if s + x <= 100}
        assert sum(x * k for x, k in got.items()) == max(sums) and all(k <= counts[x] for x, k in got.items()) and got[seed] >= 1


def test_mixing_targets_and_reruns(spark, documents, odd_docs):
    for docs in (documents, odd_docs):
        rows = mixing.mix_sources(docs).collect()
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect()))
        by = defaultdict(list)
        for r in rows:
            by[r.source].append(r)
            assert 0 <= r.taken <= 3 * r.size and r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        for group in by.values():
            assert sum(r.taken for r in group) == round(group[0].target)
            assert group[0].source_size == sum(r.size for r in group)
        sizes = sum(r.size for r in rows)
        assert sum(g[0].target for g in by.values()) == pytest.approx(sizes)


def test_realize_takes_the_words_the_mix_says(documents):
    mixed = mixing.mix_sources(documents)
    want = sum(r.taken for r in mixed.collect())
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixing.realize(mixed).collect()) == want


def test_empty_tables(empty_docs):
    assert pii.find_pii(empty_docs).count() == 0 and pii.redact(empty_docs).count() == 0
    assert quality.quality_rules(empty_docs).count() == 0 and packing.pack(empty_docs).count() == 0
    assert mixing.mix_sources(empty_docs).count() == 0


def test_odd_rows(odd_docs):
    n = odd_docs.count()
    assert pii.find_pii(odd_docs).count() == n and pii.redact(odd_docs).columns == odd_docs.columns
