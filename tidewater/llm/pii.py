"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, and a classifier of spans is trained.

Patterns propose spans.  Base kinds (email, ip, card, phone) follow fixed rules
and always stay; looser patterns propose further spans of the same kinds and of
keys ("secret").  Labelers of three sorts vote on every proposed span: shape
(regular expressions), gazetteers (words that name a kind of data) and context
(what stands next to it).  Expectation-maximisation over the counts of vote
patterns estimates how often each labeler is right; the posteriors are the
targets of a logistic classifier over votes and shape.  Votes and features are
few and discrete, so their counts over the whole corpus have a fixed bound.
Patterns run over very long texts in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, without

#: Fixed: the base kinds in their order, and the rules of each.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("secret",)
#: An address is ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, looked for at the "@" of whole runs, and an ip
#: ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, begun at whole numbers only: the same matches, in a time linear in the text.
_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?=@)")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: A key has at least so many characters of its own; there is no upper bound.
KEY_CHARS = 20
#: Further proposals: addresses without a dotted host, national telephone numbers, long keys.
#: A key is a whole run of its characters, looked at once from its start, so that the time is linear in the text.
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?[\[(] ?at ?[\])] ?)[A-Za-z0-9-]+(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]+)*"), re.compile(r"@|\bat\b")),
    ("phone", re.compile(r"(?<![\w+.-])(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\w.-])", re.ASCII), re.compile(r"\d{3}[ .-]\d{3}", re.ASCII)),
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+"), re.compile(r"[A-Za-z0-9_-]{20}")),
)
#: Fixed: words that name a kind of data when they stand before it.
GAZETTEER = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel", "address", "from", "to"),
    "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "tarjeta", "carte", "karte", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone", "contact"),
    "secret": ("token", "secret", "key", "apikey", "api_key", "password", "passwd", "pwd", "auth", "bearer"),
}
_BEFORE = 24
LABELERS = ("shape", "strict", "name", "assigned", "alone", "variety")
_ABSTAIN, _NO, _YES = 0, 1, 2
EM_ROUNDS = 50
#: Shapes of a span that the classifier tells apart.
FORMS = 16
#: A proposed span is taken if the classifier gives it at least this.
ACCEPT = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds, in order."""
    out = []
    if "@" in text:
        last = 0
        for m in _LOCAL.finditer(text):
            start, at = max(m.start(), last), m.end()  # a match before it may have taken the first part of the run
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                last = domain.end()
                out.append((start, 0, last))
    if _HAS_DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(d := p.lstrip("0") or "0") <= 3 and int(d) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_HAS_DIGIT = re.compile("[0-9]")
_WORDISH = re.compile(r"[\w-]+")


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> int:
    """The labelers' votes on a span as a number in base 3, the first labeler lowest, and above them its :func:`form`."""
    body, before, after = text[start:end], text[max(0, start - _BEFORE) : start], text[end : end + 1]
    digits = sum("0" <= c <= "9" for c in body)
    letters = sum(c.isalpha() for c in body)
    if kind == 0:
        shape = _YES if "." in body.partition("@")[2] or "dot" in body else _NO
    elif kind == 4:
        shape = _YES if digits >= 4 and (letters >= 4) else _NO
    else:
        shape = _YES if digits >= (4 if kind == 1 else 10) else _NO
    named = [w.lower() for w in _WORDISH.findall(before)][-2:]
    name = _YES if any(w in GAZETTEER[KINDS[kind]] for w in named) else _ABSTAIN
    assigned = _YES if before.rstrip()[-1:] in ("=", ":") or before[-1:] in ("\"", "'") and kind == 4 else _NO if kind == 4 else _ABSTAIN
    alone = _YES if (not before or before[-1] in " \t\n\"'(<:=,;") and (not after or after in " \t\n\"').,;>:!?#*%$&|") else _NO
    variety = len(set(body.lower()))
    spread = _YES if variety >= (8 if kind == 4 else 5) else _NO
    out = form(body, digits, letters)
    for v in reversed((shape, _YES if strict else _NO, name, assigned, alone, spread)):
        out = out * 3 + v
    return out


def form(body: str, digits: int, letters: int) -> int:
    """The span's own shape for the classifier: its length and what it is made of, each one of four."""
    size = sum(len(body) >= n for n in (12, 24, 48))
    mixture = 2 * (digits * 2 >= len(body)) + (letters * 2 >= len(body)) if digits and letters else 3 * bool(digits)
    return 4 * size + mixture


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those that meet or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def proposals(text: str) -> list[tuple[int, int, int, bool, int]]:
    """``(start, kind, end, base, votes)``: base spans, and looser ones that overlap none before them.

    A key may overlap them if enough of it lies outside: long keys hold digits
    that pass for a card by chance.
    """
    spans = base_spans(text)
    out = [(s, k, e, True, votes(text, k, s, e, True)) for s, k, e in spans]
    covered = _union([(s, e) for s, _, e in spans])
    for kind, pattern, hint in _LOOSE:
        if kind == "email" and "@" not in text and "[at]" not in text and "(at)" not in text and " at " not in text:
            continue
        if kind != "email" and not _HAS_DIGIT.search(text) or not hint.search(text):
            continue
        if kind == "email" and "@" not in text and not _OBFUSCATED.search(text):
            continue
        k, new, at = KINDS.index(kind), [], 0
        for m in pattern.finditer(text):
            s, e = m.span()
            while at < len(covered) and covered[at][1] <= s:
                at += 1
            j, inside = at, 0
            while j < len(covered) and covered[j][0] < e:
                inside += min(e, covered[j][1]) - max(s, covered[j][0])
                j += 1
            if not inside or kind == "secret" and e - s - inside >= KEY_CHARS:
                new.append((s, e))
                out.append((s, k, e, False, votes(text, k, s, e, False)))
        covered = _union(covered + new)
    return sorted(out)


_OBFUSCATED = re.compile(r"[\[(] ?at ?[\])]")


def decode(pattern: np.ndarray) -> np.ndarray:
    """Votes of each labeler, one column each."""
    return np.stack([pattern // 3**i % 3 for i in range(len(LABELERS))], 1)


def reliabilities(kinds: np.ndarray, patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Posterior of each ``(kind, votes)`` row being personal data, by expectation-maximisation.

    Each kind has a prior and each labeler, per kind, a probability of every vote
    under either class.  Labelers start as right more often than not.
    """
    v = decode(patterns)
    post = 1 / (1 + np.exp(-((v == _YES).sum(1) - (v == _NO).sum(1) * 1.2)))
    for _ in range(rounds):
        new = np.zeros_like(post)
        for k in np.unique(kinds):
            at = kinds == k
            w, p, x = counts[at].astype(float), post[at], v[at]
            prior = ((w * p).sum() + 1) / (w.sum() + 2)
            log = np.log(prior / (1 - prior)) * np.ones(at.sum())
            for i in range(x.shape[1]):
                yes, no = np.full(3, 0.5), np.full(3, 0.5)
                yes[_YES] += 2
                no[_NO] += 2
                np.add.at(yes, x[:, i], w * p)
                np.add.at(no, x[:, i], w * (1 - p))
                log += np.log(yes / yes.sum())[x[:, i]] - np.log(no / no.sum())[x[:, i]]
            new[at] = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        post = new
    return post


def features(kinds: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    v, shape = decode(patterns), patterns // 3 ** len(LABELERS)
    return np.concatenate([(v == _YES), (v == _NO), kinds[:, None] == np.arange(len(KINDS)), (shape // 4)[:, None] == np.arange(4), (shape % 4)[:, None] == np.arange(4), np.ones((len(v), 1))], 1).astype(float)


def train(kinds: np.ndarray, patterns: np.ndarray, counts: np.ndarray, target: np.ndarray, steps: int = 400, l2: float = 1e-3) -> np.ndarray:
    """Weights of the span classifier: logistic regression on soft targets, weighted by the square root of counts."""
    x = features(kinds, patterns)
    w = np.zeros(x.shape[1])
    share = np.sqrt(counts) / np.sqrt(counts).sum() if len(counts) else counts
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (share * (p - target)) + l2 * w)
    return w


def _found_type() -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32())]))


def find_proposals(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` with ``_found``, the proposed spans of the whole text."""
    kept = docs.select(*(keep or []), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [[dict(zip(("start", "kind", "end", "base", "votes"), p)) for p in proposals(t.as_py() or "")] for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, _found_type())], names=[*b.schema.names[:-1], "_found"])

    schema = type(kept.schema)(kept.schema.fields[:-1])
    ddl = docs.sparkSession.createDataFrame([], "_found array<struct<start int, kind int, end int, base boolean, votes int>>").schema
    return kept.mapInArrow(run, type(schema)(schema.fields + ddl.fields))


def fit(found: DataFrame) -> np.ndarray:
    """The classifier, from the counts of all proposed spans by kind, votes and form: at most 5 x 3^6 x 16 rows."""
    counts = found.select(F.explode("_found").alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()
    if not counts:
        return np.zeros(features(np.zeros(1, np.int64), np.zeros(1, np.int64)).shape[1])
    kinds, patterns, n = (np.array([r[i] for r in counts], np.int64) for i in range(3))
    return train(kinds, patterns, n, reliabilities(kinds, patterns, n))


def accepted(found: DataFrame, weights: np.ndarray, name: str = "spans") -> DataFrame:
    """``found`` with the column ``name``: base spans and those others that the classifier takes, by start and then kind."""
    every = FORMS * 3 ** len(LABELERS)
    kinds, patterns = (a.ravel() for a in np.meshgrid(np.arange(len(KINDS)), np.arange(every), indexing="ij"))
    good = 1 / (1 + np.exp(-features(kinds, patterns) @ weights)) >= ACCEPT
    bits = np.packbits(good, bitorder="little").tobytes()  # one bit for each kind, votes and form
    place = lambda s: s["kind"] * F.lit(every) + s["votes"]
    byte = lambda s: F.conv(F.hex(F.substring(F.lit(bits), (place(s) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    keep = F.filter("_found", lambda s: s["base"] | F.getbit(byte(s), F.pmod(place(s), F.lit(8)).cast("int")).eqNullSafe(1))
    return found.withColumn(name, F.transform(keep, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base")))).drop("_found")


def find_pii(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all by default) with ``spans``: array of start, kind, end (code points, end exclusive) and base.

    ``kind`` is a place in ``KINDS``.  Defined cases: a null or empty text has no
    spans; very long texts are read whole; repeated rows have the same spans; a table without proposed spans, or
    an empty one, trains nothing and adds none; a column named ``spans`` or
    ``_found`` is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("spans", "_found")]
    found = materialize(find_proposals(without(docs, "spans", "_found"), text_col, names), "spans")
    return accepted(found, fit(found))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets.  Overlapping spans are replaced as one, by the first kind."""
    found = materialize(find_proposals(docs, text_col, docs.columns), "spans")
    marked = accepted(found, fit(found), "_spans")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, spans in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if not spans:
                    continue
                parts, last, text = [], 0, texts[i]
                for s in spans:
                    if s["start"] >= last:
                        parts += [text[last : s["start"]], f"<{KINDS[s['kind']]}>"]
                    last = max(last, s["end"])
                texts[i] = "".join(parts) + text[last:]
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return marked.select(*names, "_spans").mapInArrow(run, docs.schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))
    line = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["base"]), line), ",")
    return found.select(id_col, *[count(k).alias(f"n_{n}") for k, n in enumerate(BASE_KINDS)], F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))
