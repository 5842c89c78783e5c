"""Token ids by segments against the tokenizer's own, over mixed and odd texts."""

import random

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewater.llm import packing
from tidewater.llm.rolling import text_slices

POOL = [
    *"abcXYZ  \n\t'’!?.,-<>|0123456789_%&", "İ", "ß", "é", "É", "é", "É", "H̱", "̇", "̸", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "'s", "'LL", "'re",
    "…", "—", "²", "½", "①", "漢字", "😀", "👩‍👩‍👧", "Σ", "ς", "ñ", "ü", "Ж", "ж", "҃", "ǅ", "ﬁ", "K", "Å", "̀", "\xa0", " ", "　", "\x85", "\x1c", "\x00", "Ա", "ა", "Ა", "ẞ", "Ⅷ", "𝒳", "ʼ", "ªº", "‍", "️",
]


def ids_of(texts, limit):
    encoder, out = packing.WordEncoder(packing.tokenizer_path()), []
    for _, _, data, offsets in text_slices(pa.array(texts, pa.large_string()), limit):
        ids, at = encoder.encode_slice(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    return out


@pytest.mark.parametrize("limit", [1, 1 << 16])
def test_ids_are_the_tokenizers_own(limit):
    rng = random.Random(7)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["", "İ!", "İ…", "İ>", "éİ…", "H̱", "<|endoftext|>x"]
    model = Tokenizer.from_file(packing.tokenizer_path())
    assert ids_of(texts, limit) == [e.ids + [packing.END_ID] for e in model.encode_batch(texts, add_special_tokens=False)]


def test_ids_with_a_small_memory(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    texts = [" ".join(f"w{i % 17} x{i % 5}" for i in range(j)) for j in range(40)] * 2
    model = Tokenizer.from_file(packing.tokenizer_path())
    assert ids_of(texts, 64) == [e.ids + [packing.END_ID] for e in model.encode_batch(texts, add_special_tokens=False)]


def test_a_very_long_text():
    text = "Lorem, ipsum'S dolor—sit é " * 40_000
    model = Tokenizer.from_file(packing.tokenizer_path())
    assert ids_of([text, None], 1 << 20) == [model.encode(text, add_special_tokens=False).ids + [packing.END_ID], [packing.END_ID]]
