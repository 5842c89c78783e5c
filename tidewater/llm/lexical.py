"""Ranked lexical search: postings in a table bucketed by term, joined with the terms of the items.

A posting is one term of one document, with its occurrences and the document's
length.  Only terms that some item asks for become postings.  The table is
bucketed by term and *shard*: a term's documents are dealt over a number of
shards that grows with the documents, so a word that every document has is no
larger in one place than a rare one.  An item's terms are joined to every shard;
each match gets an integer score, the scores of a document and an item are
summed, and a window numbers each item's documents.

What crosses the network is a row for each posting that an item asks for, not
for each item that asks for it: the items of a term travel as short lists beside
the score and are spread out where a document's rows have met.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, materialize_bucketed

#: A term is a maximal run of ASCII letters, digits and characters beyond ASCII.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP_K = 10
#: Documents of one shard, about.
SHARD_DOCS = 50_000
LEAST_SHARDS = 8
#: Items that travel in one list.
LIST_ITEMS = 256
#: Bytes of text whose terms are listed at once, and postings in one Arrow batch.
PART_BYTES, BATCH_POSTINGS = 4 << 20, 100_000

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each term of a text in UTF-8; only A-Z are lower-cased."""
    found: Counter = Counter()
    plain = (text or b"").translate(_PLAIN)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", min(start + PART_BYTES, len(plain)))
        end = len(plain) if end < 0 else end
        found.update(plain[start:end].split())
        start = end
    return found


def _count_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The columns of :func:`term_rows` for a batch of texts."""
    at, terms, tfs, ns = [], [], [], []

    def made() -> pa.RecordBatch:
        rows = batch.select(["row", "doc"]).take(pa.array(at, pa.int32()))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()), pa.array(ns, pa.int64())], names=["row", "doc", "term", "tf", "n"])

    for i, text in enumerate(batch.column("text")):
        counts = term_counts(text.as_py())
        at += [i] * len(counts)
        ns += [counts.total()] * len(counts)
        terms += counts.keys()
        tfs += counts.values()
        if len(at) >= BATCH_POSTINGS:
            yield made()
            at, terms, tfs, ns = [], [], [], []
    if at:
        yield made()


def term_rows(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(row, doc, term, tf, n): the terms of every text, with its occurrences and the text's number of terms.

    ``row`` tells rows apart whose id ``doc`` is null or repeated.
    """
    source = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _count_batch(batch)

    return source.mapInArrow(run, "row long, doc long, term string, tf long, n long")


def text_totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(N, L): how many documents have a term, and the terms of all documents."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(TERM_PATTERN)), F.lit(0)).cast("long")
    found = docs.select(n.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return found["docs"], found["terms"]


def shard_count(n_docs: int) -> int:
    return max(LEAST_SHARDS, -(-n_docs // SHARD_DOCS))


def build_postings(docs: DataFrame, terms: DataFrame | None = None, shards: int = LEAST_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of postings (term, shard, row, doc, tf, n), bucketed by (term, shard); of the column ``term`` of ``terms`` only, if given."""
    rows = term_rows(docs, id_col, text_col)
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("term", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "doc", "tf", "n")
    return materialize_bucketed(rows.repartition(buckets, "term", "shard"), "postings", ["term", "shard"], buckets)


def item_lists(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(term, items): the items that hold a term, in lists of at most ``LIST_ITEMS``."""
    pairs = term_rows(items, item_col, text_col).select("term", F.col("doc").alias("item")).distinct()
    chunk = F.floor((F.row_number().over(Window.partitionBy("term").orderBy("item")) - 1) / LIST_ITEMS)
    lists = pairs.withColumn("_chunk", chunk).groupBy("term", "_chunk", F.col("item").isNull().alias("_unnamed"))
    listed = F.when(F.col("_unnamed"), F.array(F.lit(None).cast("long"))).otherwise(F.col("_items"))  # collect_list leaves nulls out
    return lists.agg(F.sort_array(F.collect_list("item")).alias("_items")).select("term", listed.alias("items"))


def search(
    items: DataFrame,
    docs: DataFrame,
    k: int = TOP_K,
    item_col: str = "item_id",
    item_text: str = "text",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    A term weighs ``floor(1000 ln((2N+2)/(2df+1)))``; a match scores
    ``w * (10^9 tf div (1000 tf + 8 m))`` with ``m = 10 + (90 n N div L)``.

    Defined cases: ids are whole numbers; a null text has no terms; every row of
    ``docs`` is a document of its own, so repeated rows take ranks of their own,
    and null ids come last among equal scores; rows of ``items`` with one id are
    one item, and a null id is an item as well; items without terms, and those
    that no document matches, return no row; either table empty gives an empty
    result; other columns are ignored, whatever their names.  Texts of any length
    are read whole, in parts.
    """
    spark = docs.sparkSession
    lists = materialize(item_lists(items, item_col, item_text), "item-lists")
    n_docs, n_terms = text_totals(docs, text_col)
    shards = shard_count(n_docs)
    postings = build_postings(docs, lists, shards, id_col, text_col)

    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    asked = lists.join(df.select("term", weight.cast("long").alias("w")), "term").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    m = f"(10 + (90 * n * {n_docs}L) div {max(n_terms, 1)}L)"
    score = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 8 * {m}))")
    matches = postings.join(asked, ["term", "shard"]).select("row", "doc", score.alias("score"), "items").filter("score > 0")
    # By document, so that summing needs no shuffle of its own after the lists are spread out.
    spread = matches.repartition(F.col("row")).select("row", "doc", "score", F.explode("items").alias("item"))
    sums = spread.groupBy("row", "doc", "item").agg(F.sum("score").alias("score"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last(), "row")
    ranked = sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = materialize(ranked.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"), "ranked")
    for t in (lists, postings):
        discard(t)
    return found


#: The same over DuckDB's tables.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), p AS (
  SELECT doc_id, term, n, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, unnest(t) AS term FROM d) JOIN (SELECT doc_id, len(t)::BIGINT AS n FROM d) USING (doc_id) GROUP BY doc_id, term, n
), s AS (SELECT count(*)::BIGINT AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
w AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, nn
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), m AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM m WHERE score > 0
) WHERE rank <= 10
"""
