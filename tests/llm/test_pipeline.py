"""The corpus pipeline, stage by stage, against plain Python."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from tidewater.llm import common

from .test_counts import base_pii, check_packing, quality_counts
from .test_simjoin import brute


def test_stages(spark, sf_dir, documents):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = common.materialize(stage(spark, docs, sf_dir), "stage")
        assert new.columns == documents.columns
        kept[name] = (docs.collect(), new.collect())
        docs = new
    before, after = kept["quality rules"]
    ids = {r.doc_id for r in after}
    for r in before:
        n, _, _, _, repeated = quality_counts(r.text or "")
        assert r.doc_id not in ids or n >= 10 and 100 * repeated <= 20 * n
    before, after = kept["n-gram Jaccard join"]
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in brute(before)})
    before, after = kept["PII"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    assert not any(base_pii(r.text or "") for r in after) and all(r.n_chars == len(r.text) for r in after)
    before, after = kept["mixing sources"]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert abs(sum(map(size, after)) - sum(map(size, before))) <= len(Counter(r.source for r in before))
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    texts = defaultdict(list)
    for r in after:
        texts[r.doc_id].append(r.text)
    total, n = check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), texts)
    assert n <= total // 2048 + 2


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_an_empty_corpus(spark, sf_dir, empty_docs):
    docs = empty_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage")
    assert docs.count() == 0
