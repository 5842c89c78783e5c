"""Main text of web pages by consensus of each host's pages.

Every page scores its containers by the running text they hold and votes for
the generalised tag-class paths of its best ones.  Votes are summed per host in
Spark, and each page is read again under the path that its host has chosen.
A page that lacks the chosen path falls back on its own best container.  Names
of classes can drop a part of a page, but not what holds nearly all of its
running text.  Pages are read in a time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, without

#: Containers a page votes for.
VOTES = 3
#: What an ancestor gets of a block's score, per level.
DECAY = 0.75
#: Favoured containers.
_FAVOUR = {"article": 1.5, "main": 1.3}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "xmp", "noframes")}
_CONTAINERS = frozenset("html head body div section article main nav header footer aside ul ol dl table tbody thead tfoot form fieldset blockquote figure details dialog menu address center button hgroup search label object video audio canvas".split())
_BREAKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption pre hr summary option legend".split())
#: Fixed: elements that never hold an article's text, and words in class, id or role that name such parts.
_NOT_TEXT = frozenset("head nav header footer aside form fieldset dialog menu button label object video audio canvas search".split())
_NOT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside widget footer header masthead comment comments discussion disqus respond replies reader share sharing social related recommended newsletter subscribe signup login "
    "popup modal overlay pagination pager toolbar skip search contentinfo complementary dialog".split()
)
#: A part dropped by its name is taken back if it has so many times the running text of all that is left, unless its
#: name has one of these words.
TAKE_BACK = 5.0
_NEVER = frozenset("comment comments discussion disqus respond replies reader cookie cookies consent gdpr notice notices popup modal overlay ad ads advert adverts advertisement".split())
#: Words of names that speak of such a part beside the element ("with-sidebar", "no-ads").
_BESIDE = frozenset("with without has no layout".split())
_WORDS = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Node:
    __slots__ = ("tag", "label", "key", "depth", "up", "dropped", "by_name", "score", "running", "head_only", "in_article")

    def __init__(self, tag: str, name: str, up: "_Node | None", dropped: bool, by_name: "_Node | None", head_only: bool):
        self.tag, self.label, self.up, self.dropped, self.by_name, self.head_only = tag, f"{tag}.{name}" if name else tag, up, dropped, by_name, head_only
        self.score = self.running = 0.0
        self.key, self.depth = (xxhash.xxh3_64_intdigest(self.label, up.key), up.depth + 1) if up is not None else (0, 0)
        self.in_article = up is not None and (up.in_article or up.tag in ("article", "main"))

    @property
    def path(self) -> str:
        """The generalised tag-class path, from the page's root."""
        labels, node = [], self
        while node.up is not None:
            labels.append(node.label)
            node = node.up
        return "".join(f">{x}" for x in reversed(labels))


def path_key(path: str) -> int:
    """The ``key`` of nodes at a path."""
    key = 0
    for label in path.split(">")[1:]:
        key = xxhash.xxh3_64_intdigest(label, key)
    return key


def _attributes(attrs: str) -> tuple[str, bool, frozenset[str] | None]:
    """The generalised class of an element, whether it is hidden, and the words of a name that says it isn't the article's text."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return "", False, None
    name, hidden, said = "", False, None
    for key, value in _NAMED.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "class":
            name = ".".join(sorted(_DIGITS.sub("#", value.replace(">", "")).split()))
        if key == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif key == "hidden" or key == "aria-hidden":
            hidden |= value != "false"
        else:
            for part in value.split():
                words = frozenset(_WORDS.findall(part))
                if not _NOT_WORDS.isdisjoint(words) and _BESIDE.isdisjoint(words):
                    said = (said or frozenset()) | words
    return name, hidden, said


def parse(page: str) -> tuple[list[tuple[str, _Node]], list[_Node]]:
    """The blocks of text outside dropped parts, each with its container, and all containers.

    Unclosed elements end with their parent; a paragraph ends at the next block.
    """
    root = _Node("", "", None, False, None, False)
    top, nodes, blocks = root, [root], []
    open_tags: dict[str, int] = {}
    by_name: list[tuple[_Node, frozenset[str]]] = []  # parts dropped by their names, and these
    parts: list[str] = []
    linked = in_link = at = 0
    ignore = heading = False  # the current block is dropped; it is a heading

    def flush() -> None:
        nonlocal parts, linked, ignore, heading
        if parts:
            text = " ".join("".join(parts).split())
            if text and not ignore and not top.dropped and (heading or not top.head_only):
                worth = max(0, len(text) - 2 * linked) * (1.0 if len(text) > 60 else 0.4)
                blocks.append((text, top, worth))
                (top.by_name or root).running += worth
            parts, linked = [], 0
        ignore = heading = False

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and not top.dropped and not ignore:
            text = page[at:end]
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, closing = tag.lower(), m["end"] or m["end2"]
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag in _RAW and not closing:
            over = _RAW[tag].search(page, at)
            at = over.end() if over else n
            continue
        if tag not in _BREAKS:
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if tag in _CONTAINERS:
            in_link = 0
            if closing:
                if open_tags.get(tag):  # else it closes nothing
                    while top.tag != tag:
                        open_tags[top.tag] -= 1
                        top = top.up
                    open_tags[tag] -= 1
                    top = top.up
                continue
            name, hidden, said = _attributes(m["attrs"] or m["attrs2"] or "")
            if tag in ("html", "body"):
                hidden, said = False, None
                while tag == "body" and top.tag == "head":
                    open_tags["head"] -= 1
                    top = top.up
            # an article's own header keeps its headings
            head_only = top.head_only or tag == "header" and (top.in_article or top.tag in ("article", "main"))
            dropped = top.dropped or hidden and not head_only or tag in _NOT_TEXT and not (tag == "header" and head_only)
            top = _Node(tag, name, top, dropped, top.by_name, head_only)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if said and not dropped and not head_only and top.by_name is None:
                top.by_name = top
                by_name.append((top, said))
            nodes.append(top)
        elif not closing:
            heading = tag in _HEADING
            _, hidden, said = _attributes(m["attrs"] or m["attrs2"] or "")
            ignore = hidden or bool(said)
    flush()
    most = max((x for x in by_name if _NEVER.isdisjoint(x[1])), key=lambda x: x[0].running, default=(root, None))[0]
    kept = most if most is not root and most.running > TAKE_BACK * root.running else None
    for node in nodes:
        node.dropped |= node.by_name is not None and node.by_name is not kept
    blocks = [b for b in blocks if not b[1].dropped]
    for _, node, worth in blocks:
        while node is not None and worth > 0.5:
            node.score += worth
            worth, node = worth * DECAY, node.up
    return [(text, node) for text, node, _ in blocks], nodes


def _best(nodes: list[_Node]) -> list[_Node]:
    scored = [x for x in nodes if x.score > 0 and not x.dropped]
    return sorted(scored, key=lambda x: (-x.score * _FAVOUR.get(x.tag, 1.0), x.depth))


def page_votes(page: str) -> list[tuple[str, float]]:
    """Paths of the page's best containers, with their shares of the page's score."""
    best = _best(parse(page)[1])[:VOTES]
    total = sum(x.score * _FAVOUR.get(x.tag, 1.0) for x in best)
    votes: dict[str, float] = {}
    for x in best:
        share = x.score * _FAVOUR.get(x.tag, 1.0) / total
        votes[x.path] = max(votes.get(x.path, 0.0), share)
    return list(votes.items())


def main_text(page: str | None, path: str | None) -> str:
    """The blocks inside the containers at ``path``, or else inside the page's best container."""
    if not page:
        return ""
    blocks, nodes = parse(page)
    key = path_key(path) if path is not None else None
    chosen = _inside(nodes, {id(x) for x in nodes if x.key == key and x.up is not None} if path else {id(nodes[0])} if path == "" else set())
    if not any(id(b) in chosen for _, b in blocks):
        best = _best(nodes)
        chosen = _inside(nodes, {id(best[0] if best else nodes[0])})
    return "\n\n".join(t for t, b in blocks if id(b) in chosen)


def _inside(nodes: list[_Node], chosen: set[int]) -> set[int]:
    """The chosen nodes and all below them; nodes come after what they lie in."""
    out = set(chosen)
    for node in nodes:
        if node.up is not None and id(node.up) in out:
            out.add(id(node))
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(_host, _path)``: the path with most votes of each host, ties by the path."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[tuple[str, str], float] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            for path, share in page_votes(page.as_py() or ""):
                sums[host, path] = sums.get((host, path), 0.0) + share
        return pa.record_batch({"_host": pa.array([k[0] for k in sums], pa.string()), "_path": pa.array([k[1] for k in sums], pa.string()), "n": pa.array([round(v * 1_000_000) for v in sums.values()], pa.int64())})

    votes = map_arrow(pages.select(host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html")), run, "_host string, _path string, n long")
    sums = votes.groupBy("_host", "_path").agg(F.sum("n").alias("n"))
    return sums.groupBy("_host").agg(F.min(F.struct((-F.col("n")).alias("n"), "_path"))["_path"].alias("_path"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all but the html by default) with ``text`` and ``n_chars``.

    Defined cases: null or empty html gives an empty text; pages without a host
    (null or odd urls) vote together; repeated rows give repeated results; very
    long pages are read whole; columns named like an added one are replaced; an
    empty table gives an empty one.
    """
    names = [c for c in (keep or [c for c in pages.columns if c != html_col]) if c.lower() not in ("text", "n_chars", "_host", "_path")]
    winners = materialize(host_paths(pages, url_col, html_col), "paths")
    source = pages.select(*names, F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host"))
    joined = source.join(winners, "_host", "left").select(*names, "_html", "_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.num_columns - 2
            texts = [main_text(h.as_py(), p.as_py()) for h, p in zip(b.column(k), b.column(k + 1))]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*names, "text", "n_chars"])

    kept = without(joined, "_html", "_path").schema
    added = pages.sparkSession.createDataFrame([], "text string, n_chars long").schema
    return joined.mapInArrow(run, type(kept)(kept.fields + added.fields))
