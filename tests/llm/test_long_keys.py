"""Keys of any length are proposed whole and leave the text."""

import random
import re
import time

import pytest

from tidewater.llm import pii

LENGTHS = (20, 128, 129, 500, 5000)


def key(n, letters="0123456789abcdef", seed=0):
    rng = random.Random(f"{n} {seed}")
    return "a1b2c3d4" + "".join(rng.choice(letters) for _ in range(n - 8))


def keys_in(text):
    return [(s, e) for s, k, e, _, _ in pii.proposals(text) if pii.KINDS[k] == "secret"]


@pytest.mark.parametrize("n", LENGTHS)
def test_a_key_is_proposed_whole(n):
    for k in (key(n), key(n, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-")):
        assert keys_in(f'token = "{k}" and more') == [(9, 9 + n)]


def test_a_key_around_digits_that_pass_for_a_card():
    before, after = "a" * 300, "b" * 300
    text = f"key: {before}4337166598464399{after} end"
    assert (305, 321) in [(s, e) for s, k, e, base, _ in pii.proposals(text) if base] and keys_in(text) == [(5, 621)]
    assert keys_in("pay with card-4337-1665-9846-4399 now") == []


def test_the_middle_of_a_long_token_is_proposed():
    parts = [key(n, "0123456789ABCDEFabcdef_-", n) + "1" for n in (36, 700, 43)]
    assert [e - s for s, e in keys_in("bearer " + ".".join(parts))] == [37, 701, 44]


def test_keys_leave_the_text(spark):
    rows = [(i, f'token = "{key(n, seed=i)}" and more') for i, n in enumerate(LENGTHS * 8)]
    for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.text == 'token = "<secret>" and more' or re.fullmatch(r'token = "<card>" and more', r.text)


def test_the_pattern_is_linear():
    pattern = dict((k, p) for k, p, _ in pii._LOOSE)["secret"]
    began = time.perf_counter()
    assert not pattern.findall("-" * 20_000) and not pattern.findall("a-" * 10_000)
    assert len(pattern.findall("a1-" * 10_000)) == 1
    assert time.perf_counter() - began < 1
