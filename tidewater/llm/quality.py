"""Quality rules: counts of a text, and its divergence from language references.

A document is compared with every language's reference by Jensen-Shannon
distance, once over classes of characters and once over common words, and has to
come near one of them.  Short texts, whose histograms say little, are exempt.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, map_arrow

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A common word makes up at least this share of its language's words.
COMMON_SHARE = 0.005
#: Guards: with fewer characters or words, a histogram is not judged.
MIN_CHARS_FOR_CLASSES = 60
MIN_WORDS_FOR_COMMON = 40
#: Largest distances (0 to 1) from the nearest reference that are still prose.
MAX_CLASS_DISTANCE = 0.17
MAX_WORD_DISTANCE = 0.36

#: Fixed: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
CLASSES = ("space", "break", "lower", "upper", "letter", "digit", "stop", "mark", "symbol", "other")
_STOPS = ".,;:'\"()-?"


def _class_table() -> np.ndarray:
    """The class of each code point of the basic plane; those above are looked up as its last entry."""
    out = np.full(0x10000, CLASSES.index("other"), np.uint8)
    kinds = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lm": "letter", "Lo": "letter", "Mn": "letter", "Mc": "letter", "Nd": "digit"}
    for c in range(0x10000):
        if (k := kinds.get(unicodedata.category(chr(c)))) is not None:
            out[c] = CLASSES.index(k)
    for chars, k in (("\t\n\x0b\x0c\r", "break"), (" ", "space"), (_STOPS, "stop"), ("!", "mark"), (SYMBOLS, "symbol")):
        for c in chars:
            out[ord(c)] = CLASSES.index(k)
    return out


_TABLE = _class_table()
_SYMBOL = CLASSES.index("symbol")


def class_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_TABLE[np.minimum(points, 0xFFFF)], minlength=len(CLASSES))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window which the text has at least twice."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 5 - max(i, end)
            end = i + 5
    return covered


def duplicate_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of ``p`` to each row of ``q``."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return np.sqrt(np.maximum(0.0, (left + right) / 2))


def common_words(docs: DataFrame, share: float = COMMON_SHARE) -> dict[str, dict[bytes, int]]:
    """Per language, the words that make up at least ``share`` of its words, with exact counts over all documents.

    A word of that share has at least half of it in batches where it makes up
    half the share, so what such batches report finds every common word, and at
    most ``2 / share`` candidates a language need an exact count.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batch: pa.RecordBatch, only: dict[str, set[bytes]] | None = None) -> pa.Table:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            found.setdefault(lang, Counter()).update(text.encode("utf-8", "surrogatepass").lower().split())
        rows = []
        for lang, words in found.items():
            total = words.total()
            rows.append((lang, b"", total))
            if only is None:
                rows += [(lang, w, n) for w, n in words.items() if n >= total * share / 2]
            else:
                rows += [(lang, w, words[w]) for w in only.get(lang, ()) if words[w]]
        return pa.table({"lang": pa.array([r[0] for r in rows], pa.string()), "word": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.int64())})

    def summed(fn, least: float) -> dict[str, dict[bytes, int]]:
        sums = map_arrow(labelled, fn, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        totals = sums.filter(F.length("word") == 0).select("lang", F.col("n").alias("total"))
        out: dict[str, dict[bytes, int]] = {}
        for r in sums.join(totals, "lang").filter((F.length("word") == 0) | (F.col("n") >= F.col("total") * least)).collect():
            out.setdefault(r.lang, {})[bytes(r.word)] = r.n
        return out

    likely = {lang: set(words) - {b""} for lang, words in summed(count, share / 2).items()}
    return summed(lambda batch: count(batch, likely), share)


class References:
    """Language references: a class histogram and a common-word histogram each; a few KB a language."""

    def __init__(self, words: dict[str, dict[bytes, int]], classes: dict[str, list[int]]):
        self.langs = sorted(set(words) & set(classes))
        self.vocabulary = sorted({w for lang in self.langs for w in words[lang]} - {b""})
        self.column = {w: i for i, w in enumerate(self.vocabulary)}
        c = np.array([classes[x] for x in self.langs], float).reshape(len(self.langs), len(CLASSES))
        self.classes = c / np.maximum(c.sum(1, keepdims=True), 1)
        w = np.array([[words[x].get(v, 0) for v in self.vocabulary] + [words[x].get(b"", 0)] for x in self.langs], float).reshape(len(self.langs), len(self.vocabulary) + 1)
        w[:, -1] -= w[:, :-1].sum(1)
        self.words = w / np.maximum(w.sum(1, keepdims=True), 1)


def language_references(docs: DataFrame, share: float = COMMON_SHARE) -> References:
    """References from every document with a text and a language."""

    def count(batch: pa.RecordBatch) -> pa.Table:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            sums[lang] = sums.get(lang, 0) + class_histogram(text)
        return pa.table({"lang": pa.array(list(sums), pa.string()), "n": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))})

    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = map_arrow(labelled, count, "lang string, n array<long>")
    rows = counted.groupBy("lang").agg(*[F.sum(F.col("n")[i]).alias(f"c{i}") for i in range(len(CLASSES))]).collect()
    return References(common_words(docs, share), {r.lang: [r[f"c{i}"] for i in range(len(CLASSES))] for r in rows})


def judge(texts: list[str | None], refs: References) -> dict[str, list]:
    """The counts of each text, and the verdict."""
    n = len(texts)
    hist, common = np.zeros((n, len(CLASSES))), np.zeros((n, len(refs.vocabulary) + 1))
    n_words, dup, rep = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        hist[i] = class_histogram(text)
        n_words[i], dup[i], rep[i] = len(words), duplicate_lines(data), repeated_words(words)
        for w, k in Counter(data.lower().split()).items():
            if (c := refs.column.get(w)) is not None:
                common[i, c] = k
    common[:, -1] = n_words - common[:, :-1].sum(1)
    chars = hist.sum(1)
    separators = hist[:, CLASSES.index("space")] + hist[:, CLASSES.index("break")]
    failed = (n_words < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n_words)
    if refs.langs:
        by_class = np.concatenate([js_distance(h / np.maximum(h.sum(1, keepdims=True), 1), refs.classes).min(1) for h in np.array_split(hist, n // 500 + 1)])
        by_word = np.concatenate([js_distance(h / np.maximum(h.sum(1, keepdims=True), 1), refs.words).min(1) for h in np.array_split(common, n // 500 + 1)])
    else:
        by_class = by_word = np.zeros(n)
    strange = (chars >= MIN_CHARS_FOR_CLASSES) & (by_class > MAX_CLASS_DISTANCE) | (n_words >= MIN_WORDS_FOR_COMMON) & (by_word > MAX_WORD_DISTANCE)
    return {
        "n_words": n_words, "word_chars": (chars - separators).astype(np.int64), "n_symbols": hist[:, _SYMBOL].astype(np.int64),
        "n_dup_lines": dup, "n_repeat_words": rep, "class_distance": by_class, "word_distance": by_word, "base_failed": failed, "kept": ~failed & ~strange,
    }


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, refs: References | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with counts and verdicts.

    Defined cases: a null or empty text has no words and fails; without any
    labelled document there are no references and only the base rules speak;
    repeated rows are judged alike; very long texts are read whole, in a time
    linear in them; an empty table stays empty; input columns
    named like an added one are replaced.
    """
    refs = refs or language_references(docs)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {k: pa.array(v) for k, v in judge(batch.column("text").to_pylist(), refs).items()}

    return annotate(docs, run, ADDED, keep)
