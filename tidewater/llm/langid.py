"""Language of whole texts by a byte convolutional network written in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows,
each filter's maximum over the window is kept, and a softmax layer names the
language.  A text is cut into windows from its first byte to its last, and its
windows' probabilities are averaged by length.  The network is trained on the
driver from a bounded sample of labelled rows; everything else is one pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotate, map_arrow, without

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, DIM = 12, 8
#: The bound of the training sample: about this many documents a language (never over twice as many), this many windows of each.
SAMPLE_PER_LANG, WINDOWS_PER_DOC = 600, 3
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"
#: Windows run through the network at once, so that what they need stays in cache.
CHUNK = 16

_WORDISH = re.compile(r"[^\W\d_]")
#: Labels that are learned: those with most rows, so that dirty labels don't make the network grow.
MAX_LANGS = 256
#: Byte classes: upper-case ASCII is read as lower case, digits and control bytes as one each.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[1:32] = 32


@dataclass
class ByteCNN:
    langs: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, langs: list[str], seed: int = 7) -> "ByteCNN":
        rng = np.random.default_rng(seed)
        w = {"embed": rng.normal(0, 0.5, (256, DIM))}
        for k in WIDTHS:
            w[f"conv{k}"] = rng.normal(0, (k * DIM) ** -0.5, (k * DIM, FILTERS))
            w[f"bias{k}"] = np.zeros(FILTERS)
        w["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs)))
        w["out_bias"] = np.zeros(len(langs))
        return cls(langs, {n: x.astype(np.float32) for n, x in w.items()})

    def _filters(self) -> np.ndarray:
        """The filters of all widths side by side, the narrower ones filled up with zeros."""
        out = np.zeros((max(WIDTHS) * DIM, len(WIDTHS) * FILTERS), np.float32)
        for i, k in enumerate(WIDTHS):
            out[: k * DIM, i * FILTERS : (i + 1) * FILTERS] = self.weights[f"conv{k}"]
        return out

    def _responses(self, windows: np.ndarray, filters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every filter's response at every place (n, places, filters), and the embedded windows; zeros follow a window."""
        n, size, widest = len(windows), windows.shape[1], max(WIDTHS)
        padded = np.zeros((n, size + widest - 1), np.uint8)
        padded[:, :size] = windows
        x = self.weights["embed"][padded].reshape(n, -1)
        cols = np.lib.stride_tricks.as_strided(x, (n, size, widest * DIM), (x.strides[0], DIM * x.itemsize, x.itemsize))
        return (np.ascontiguousarray(cols).reshape(n * size, widest * DIM) @ filters).reshape(n, size, -1), x

    def _hidden(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + np.concatenate([self.weights[f"bias{k}"] for k in WIDTHS]), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out, filters = np.empty((len(windows), len(self.langs)), np.float32), self._filters()
        for i in range(0, len(windows), CHUNK):
            z = self._hidden(self._responses(windows[i : i + CHUNK], filters)[0].max(1)) @ self.weights["out"] + self.weights["out_bias"]
            z = np.exp(z - z.max(1, keepdims=True))
            out[i : i + CHUNK] = z / z.sum(1, keepdims=True)
        return out

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(windows)
        y, x = self._responses(windows, self._filters())
        at = y.argmax(1)
        h = self._hidden(np.take_along_axis(y, at[:, None, :], 1)[:, 0])
        z = h @ w["out"] + w["out_bias"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), target] -= 1
        p /= n
        g = {"out": h.T @ p, "out_bias": p.sum(0), "embed": np.zeros_like(w["embed"])}
        dh = (p @ w["out"].T) * (h > 0)
        x = x.reshape(n, -1, DIM)
        padded = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))
        for i, k in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            spots = at[:, i * FILTERS : (i + 1) * FILTERS, None] + np.arange(k)  # n, FILTERS, k
            patches = x[np.arange(n)[:, None, None], spots].reshape(n, FILTERS, k * DIM)
            g[f"conv{k}"] = np.einsum("nfc,nf->cf", patches, d)
            g[f"bias{k}"] = d.sum(0)
            back = (d[:, :, None] * w[f"conv{k}"].T[None]).reshape(n, FILTERS, k, DIM)
            np.add.at(g["embed"], padded[np.arange(n)[:, None, None], spots], back)
        return g

    def train(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> "ByteCNN":
        rng, step = np.random.default_rng(seed), 0
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for epoch in range(epochs):
            rate = RATE * (1 - 0.8 * epoch / max(1, epochs - 1))
            order = rng.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                step += 1
                for k, g in self.gradients(windows[order[i : i + BATCH]], target[order[i : i + BATCH]]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.weights[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def has_letter(text: str) -> bool:
    """Whether a character is a letter; signs for numbers such as "½" and "²" are none."""
    return any(m[0].isalpha() for m in _WORDISH.finditer(text))


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text's bytes, the last filled up with zeros."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = _FOLD[np.frombuffer(data, np.uint8)]
    return out.reshape(n, size)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN:
    """A network from a sample of labelled rows outside the held-out part, at most ``2 * per_lang`` a language."""
    known = docs.filter(~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MAX_LANGS).collect()}
    if not counts:
        return ByteCNN([])
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(per_lang / n)).otherwise(share)
    hashed = F.xxhash64(F.col(id_col), F.col(text_col))
    drawn = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), hashed.alias("h")).filter(F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, hashes, made = [], [], []
        for lang, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text = text.as_py()
            if has_letter(text):
                w = windows_of(text.encode("utf-8", "surrogatepass"))
                chosen = np.random.default_rng(h % (1 << 32)).permutation(len(w))[:WINDOWS_PER_DOC]
                langs.append(lang), hashes.append(h), made.append(w[chosen].tobytes())
        return pa.record_batch({"lang": pa.array(langs, pa.string()), "h": pa.array(hashes, pa.int64()), "w": pa.array(made, pa.binary())})

    # a few hundred bytes a document, at most twice as many documents as are wanted
    rows = map_arrow(drawn, cut, "lang string, h long, w binary").limit(2 * per_lang * len(counts)).collect()
    rows.sort(key=lambda r: (r.h, r.lang, bytes(r.w)))
    langs = sorted(counts)
    x = [np.frombuffer(r.w, np.uint8).reshape(-1, WINDOW) for r in rows]
    y = [langs.index(r.lang) for r, w in zip(rows, x) for _ in w]
    return ByteCNN.start(langs).train(np.concatenate(x), np.array(y)) if x else ByteCNN([])


def predict(docs: DataFrame, net: ByteCNN, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        n = batch.num_rows
        best, score = [UNKNOWN] * n, np.zeros(n)
        pending: list[tuple[int, int]] = []
        held: list[np.ndarray] = []

        def flush() -> None:
            if not held:
                return
            windows = np.concatenate(held)
            p = net.probabilities(windows) * (windows != 0).sum(1, keepdims=True)
            at = 0
            for i, k in pending:
                total = p[at : at + k].sum(0)
                c = int(total.argmax())
                best[i], score[i] = net.langs[c], min(1.0, float(total[c] / total.sum()))
                at += k
            pending.clear(), held.clear()

        waiting = 0
        for i, text in enumerate(batch.column(batch.schema.get_field_index(text_col))):
            text = text.as_py()
            if not text or not net.langs or not has_letter(text):
                continue
            w = windows_of(text.encode("utf-8", "surrogatepass"))
            pending.append((i, len(w))), held.append(w)
            waiting += len(w)
            if waiting >= 4096:
                flush()
                waiting = 0
        flush()
        return {"lang_pred": pa.array(best, pa.string()), "score": pa.array(score, pa.float64())}

    return annotate(docs, run, "lang_pred string, score double", keep)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Train on the rows outside the held-out part and predict every row: ``held_out``, ``lang_pred`` and ``score`` are added.

    Defined cases: a null text, or one without a letter, is ``und`` with score 0
    (signs for numbers are no letters); a very long text is read whole, in windows;
    so is every text if nothing is labelled; a null id is not held out; repeated
    rows are predicted alike; columns named like an added one are replaced.
    """
    net = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    base = without(docs, "held_out").withColumn("held_out", held_out(F.col(id_col)))
    names = [c for c in (keep or docs.columns) if c.lower() not in ("held_out", "lang_pred", "score")]
    return predict(base.select(*dict.fromkeys([*names, "held_out", text_col])), net, text_col, [*names, "held_out"])
