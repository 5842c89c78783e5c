"""Token counts that follow edits.

A document's pre-tokens (the pieces that the tokenizer's pattern cuts a text
into, each encoded by itself) lie in blocks, and a segment tree over the blocks
sums their characters and tokens.  An edit descends to the block it touches by
the sums of characters, cuts only the touched region and its boundary context
into pre-tokens anew, until a boundary of the old text comes back, puts the new
leaves in place of the old ones and updates the sums on the way up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens in a block of a new tree.
BLOCK = 64
#: Pre-tokens before the touched one that may end elsewhere after an edit: white space looks ahead past the next piece's first character.
CONTEXT = 2
CACHE_PIECES, CACHE_CHARS = 500_000, 40


class PieceCounter:
    """Tokens of one pre-token, remembered."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex
        import tiktoken

        path = path or public_tokenizers.path(VOCABULARY)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.known = regex.compile(public_tokenizers.PATTERN), {}

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, pieces: list[str]) -> list[int]:
        new = set(pieces).difference(self.known)
        if new:
            if len(self.known) > CACHE_PIECES:
                self.known = {}
                new = set(pieces)
            made = {p: len(self.encoding.encode_ordinary(p)) for p in new}
            out = [made[p] if p in made else self.known[p] for p in pieces]
            self.known.update((p, n) for p, n in made.items() if len(p) <= CACHE_CHARS)
            return out
        return list(map(self.known.__getitem__, pieces))


@lru_cache(2)
def counter(path: str | None = None) -> PieceCounter:
    return PieceCounter(path)


class TokenTree:
    """A segment tree over blocks of pre-tokens: ``chars`` and ``tokens`` hold the sums, the root at 1."""

    __slots__ = ("lengths", "counts", "size", "chars", "tokens", "encoded")

    def __init__(self, lengths: list[list[int]], counts: list[list[int]]):
        self.lengths, self.counts, self.encoded = lengths, counts, 0
        self.size = 1
        while self.size < len(lengths):
            self.size *= 2
        for blocks in (lengths, counts):
            blocks.extend([] for _ in range(self.size - len(blocks)))
        self.chars = [0] * self.size + [sum(b) for b in lengths]
        self.tokens = [0] * self.size + [sum(b) for b in counts]
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @classmethod
    def build(cls, text: str, counts: PieceCounter) -> "TokenTree":
        pieces = counts.pieces(text)
        n, k = list(map(len, pieces)), counts.counts(pieces)
        return cls([n[i : i + BLOCK] for i in range(0, len(n), BLOCK)] or [[]], [k[i : i + BLOCK] for i in range(0, len(k), BLOCK)] or [[]])

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int, int]:
        """Block, place in it and first character of the pre-token that holds character ``at`` (the last one for the end)."""
        at = min(at, max(0, self.chars[1] - 1))
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        block = node - self.size
        for i, n in enumerate(self.lengths[block]):
            if at < start + n:
                return block, i, start
            start += n
        return block, len(self.lengths[block]), start

    def _back(self, block: int, i: int, start: int, steps: int) -> tuple[int, int, int]:
        """Up to ``steps`` pre-tokens earlier."""
        while steps:
            if i:
                i -= 1
                start -= self.lengths[block][i]
                steps -= 1
                continue
            earlier = block - 1
            while earlier >= 0 and not self.lengths[earlier]:
                earlier -= 1
            if earlier < 0:
                break
            block, i = earlier, len(self.lengths[earlier])
        return block, i, start

    def edit(self, text: str, start: int, end: int, new: str, counts: PieceCounter) -> str:
        """The text with ``text[start:end]`` replaced by ``new``; the tree follows."""
        start = max(0, min(start, len(text)))
        end = max(start, min(end, len(text)))
        after = text[:start] + new + text[end:]
        block, i, first = self._back(*self.find(max(0, start - 1)), CONTEXT)
        shift = len(after) - len(text)
        # old boundaries behind the edit, met one by one as the new text is cut
        b, j, old = block, i, first
        made: list[str] = []
        at = first
        for m in counts.pattern.finditer(after, first):
            while b < self.size and old + shift < at:
                if j < len(self.lengths[b]):
                    old += self.lengths[b][j]
                    j += 1
                else:
                    b, j = b + 1, 0
            if at >= start + len(new) and old >= end and old + shift == at:
                break
            made.append(m.group())
            at = m.end()
        else:
            b, j = self.size - 1, len(self.lengths[self.size - 1])
        self._replace(block, i, b, j, list(map(len, made)), counts.counts(made))
        self.encoded += len(made)
        return after

    def _replace(self, block: int, i: int, last: int, j: int, lengths: list[int], counts: list[int]) -> None:
        """Leaves from ``(block, i)`` up to ``(last, j)`` give way to new ones, which join the first block."""
        for own, new in ((self.lengths, lengths), (self.counts, counts)):
            if block == last:
                own[block][i:j] = new
            else:
                own[block][i:] = new
                for b in range(block + 1, last):
                    own[b] = []
                del own[last][:j]
        for b in range(block, last + 1):
            self._sum(b)
        if len(self.lengths[block]) > 8 * BLOCK:
            self._deal()

    def _sum(self, block: int) -> None:
        node = self.size + block
        self.chars[node], self.tokens[node] = sum(self.lengths[block]), sum(self.counts[block])
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def _deal(self) -> None:
        """Blocks of even size again, when edits have filled one; nothing is encoded anew."""
        encoded = self.encoded
        n, k = [x for b in self.lengths for x in b], [x for b in self.counts for x in b]
        self.__init__([n[i : i + BLOCK] for i in range(0, len(n), BLOCK)], [k[i : i + BLOCK] for i in range(0, len(k), BLOCK)])
        self.encoded = encoded


_LEAVES = "array<array<int>>"
_EDITS = "array<struct<start:int,end:int,new:string>>"


def build_trees(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``lengths`` and ``counts``, the leaves of each document's tree by block, and ``n_tokens``.  Null texts are empty."""
    base = without(docs, "lengths", "counts", "n_tokens")
    at = base.columns.index(text_col)
    added = T._parse_datatype_string(f"lengths {_LEAVES}, counts {_LEAVES}, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [TokenTree.build(t.as_py() or "", counter(path)) for t in b.column(at)]
            nested = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.lengths for t in trees], nested), pa.array([t.counts for t in trees], nested), pa.array([t.total for t in trees], pa.int64())], names=[*b.schema.names, "lengths", "counts", "n_tokens"])

    return base.mapInArrow(run, T.StructType(base.schema.fields + added.fields))


def apply_edits(state: DataFrame, edits_col: str = "edits", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The state of :func:`build_trees` after each row's edits: text, leaves and ``n_tokens`` are the new ones.

    ``edits_col`` is an array of (start, end, new) structs in characters, applied
    in order, each to the text the one before it left; offsets outside the text
    are moved to its ends, and a null replacement is empty.
    """
    names = [c for c in state.columns if c != edits_col]
    where = {c: names.index(c) for c in (text_col, "lengths", "counts", "n_tokens")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in where}
            rows = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (text_col, "lengths", "counts", edits_col)))
            for text, lengths, counts, edits in rows:
                tree, new = TokenTree(lengths, counts), text
                for e in edits or ():
                    new = tree.edit(new or "", e["start"], e["end"], e["new"] or "", counter(path))
                for c, v in zip((text_col, "lengths", "counts", "n_tokens"), (new, tree.lengths, tree.counts, tree.total)):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], b.schema.field(c).type) if c in out else b.column(b.schema.get_field_index(c)) for c in names], names=names)

    return state.mapInArrow(run, T.StructType([state.schema[c] for c in names]))


def count_edits(docs: DataFrame, edits_col: str = "edits", text_col: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Counts before and after each row's edits, the trees living only inside the task.

    Returns the columns in ``keep`` with ``n_tokens``, ``n_tokens_after``,
    ``n_pieces`` (pre-tokens before) and ``n_encoded`` (pre-tokens cut anew for
    the edits).  Defined cases: a null text is empty and edits may fill it; very
    long texts are read whole, and an edit costs what its region does; null
    edits are none; repeated rows count alike; an empty table stays empty.
    """
    names = [c for c in (keep or []) if c.lower() not in ("n_tokens", "n_tokens_after", "n_pieces", "n_encoded")]
    base = docs.select(*names, F.col(text_col).alias("_text"), F.col(edits_col).cast(_EDITS).alias("_edits"))
    added = T._parse_datatype_string("n_tokens long, n_tokens_after long, n_pieces long, n_encoded long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            out: list[list[int]] = [[], [], [], []]
            k = b.num_columns - 2
            for text, edits in zip(b.column(k), b.column(k + 1).to_pylist()):
                text = text.as_py() or ""
                tree = TokenTree.build(text, count)
                before, pieces = tree.total, sum(map(len, tree.lengths))
                for e in edits or ():
                    text = tree.edit(text, e["start"], e["end"], e["new"] or "", count)
                for c, v in zip(out, (before, tree.total, pieces, tree.encoded)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *[pa.array(c, pa.int64()) for c in out]], names=[*names, *added.names])

    kept = base.drop("_text", "_edits").schema
    return base.mapInArrow(run, T.StructType(kept.fields + added.fields))


def sample_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with three edits each, fixed by id: an insertion, a deletion and a replacement somewhere in the text."""
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    at = lambda k: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), n + 1).cast("int")
    edit = lambda s, e, new: F.struct(s.alias("start"), e.cast("int").alias("end"), F.lit(new).alias("new"))
    return docs.withColumn("edits", F.array(edit(at(1), at(1), " it's 2,048 new words\n"), edit(at(2), at(2) + 17, ""), edit(at(3), at(3) + 5, "é's  ")))
