"""Very long and odd inputs end soon and give what the definitions say."""

import random
import re
import time

import numpy as np
import pytest

from tidewater.llm import html, langid, pii, simjoin

from .test_counts import base_pii

PROSE = "A long running paragraph about the harbour, the boats and the weather that goes on for a good while. " * 3


@pytest.mark.parametrize("page, kept", [
    (f'<article class="menu-recipe"><p>{PROSE}</p></article>', True),
    (f'<body><main class="header-less"><p>{PROSE}</p></main><div id="comments"><p>{PROSE * 9}</p></div></body>', True),
    (f'<div class="content-sidebar"><h1>T</h1><p>{PROSE}</p></div><footer>{PROSE}</footer>', True),
    (f'<div id="comments"><p>{PROSE}</p></div>', False), (f'<div class="cookie-banner"><p>{PROSE}</p></div>', False), (f'<nav><p>{PROSE}</p></nav>', False),
])
def test_names_drop_no_article(page, kept):
    text = html.main_text(page, None)
    assert (text.split("\n\n")[-1] == PROSE.strip()) if kept else not text


def test_names_drop_parts_beside_an_article():
    page = f'<body><div class="sidebar"><p>{PROSE}</p></div><article><p>{PROSE}</p></article><div class="related"><p>{PROSE}</p></div></body>'
    assert html.main_text(page, None) == PROSE.strip()
    path = html.page_votes(page)[0][0]
    assert path == ">body>article" and html.main_text(page, path) == PROSE.strip()
    assert html.main_text("", None) == html.main_text(None, ">x") == ""


@pytest.mark.parametrize("page", ["<div>" * 8000 + "</p></x></section>" * 32000 + PROSE, "<div class='a b1'>" * 30000 + "</div>" * 30000 + PROSE, "<p>" * 10**6, "&amp;" * 10**6, "<" * 10**6])
def test_long_pages(page):
    began = time.process_time()
    html.main_text(page, ">body>div")
    html.page_votes(page)
    assert time.process_time() - began < 20


@pytest.mark.parametrize("text", ["0" * 5000 + ".1.2.3 x", "a" * 10**6 + " x@y.de", "1" * 10**6 + " +", "a1" * 500_000 + "@", "1.2.3 " * 200_000, "+1" + " " * 10**6, "x@y.de " * 100_000, "(203) 555-1234 " * 50_000])
def test_long_texts_for_personal_data(text):
    began = time.process_time()
    pii.proposals(text)
    assert time.process_time() - began < 20


def test_base_rules_on_random_texts():
    rng = random.Random(5)
    pool = [*"ab1234567890..@@--++__%  ()é", "1.2.3.4", "a@b.c", "+1 ", "255", "4337166598464399", "256.", "00"]
    for _ in range(20_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))
        assert pii.base_spans(text) == sorted((s, pii.KINDS.index(k), e) for s, _, k, e in base_pii(text))


def test_the_classifier_sees_more_than_votes():
    kinds, votes = np.zeros(4, np.int64), np.array([5, 5, 5, 5]) + np.array([0, 1, 4, 15]) * 3**6
    rows = pii.features(kinds, votes)
    assert len(np.unique(rows, axis=0)) == 4 and (pii.decode(votes) == pii.decode(votes[:1])).all()


def test_letters():
    assert [langid.has_letter(t) for t in ("½", "①²", "x½", "ª", "", "12 _", "é", "漢")] == [False, False, True, True, False, False, True, True]


def test_one_text_of_a_component_whose_ids_repeat(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, base + " more"), (None, base + " again"), (None, "quite another text with more than five words"), (None, None), (None, None), (2, "")]
    kept = simjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [r.text for r in kept]
    assert len([t for t in texts if t and t.startswith("w0")]) == 1 and texts.count(None) == 1 and len(kept) == 4
    assert any(t and re.match("quite", t) for t in texts)
