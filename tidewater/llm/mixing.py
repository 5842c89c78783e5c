"""Mix sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Within its source, documents are put in
key order by ranges: the leading digits of the key choose a range, range totals
are summed into a prefix table (small: sources x 16^digits rows), and only the
running sum inside one range needs rows sorted together.  A source whose target
exceeds its size is repeated whole as often as it fits; the last pass is cut at
the exact remaining budget, so the document on the cut is taken in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, without, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Leading hex digits of the key that name a range: 4,096 ranges a source.
RANGE_DIGITS = 3

_ADDED = ("size", "source_size", "target", "taken")


def mix_key(doc_id: Column, seed: str = SEED) -> Column:
    """The hash-random key of a document, the same in any engine with md5."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of ``(source, source_size)`` rows: weights repeat over the sources in code point order, null last.

    The targets share the sum of all sizes by weight, and no target is above
    ``max_epochs`` times its source.  In order of the ratio of cap to weight, the
    sources that hit their cap come first, and each can be told from the sums
    before and after it, so one pass gives what resharing the excess until
    nothing is above would give.  The table has one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.select("source", "source_size", w.cast("double").alias("_w"), (F.col("source_size") * max_epochs).cast("double").alias("_cap"))
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("_all", F.sum("source_size").over(whole).cast("double"))
    t = t.withColumn("_capped", F.col("_cap") * after <= F.col("_w") * (F.col("_all") - before))
    left = F.col("_all") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(whole)
    free = F.sum(F.when(~F.col("_capped"), F.col("_w")).otherwise(0.0)).over(whole)
    return t.select("source", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * left / F.nullif(free, F.lit(0.0))).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    range_digits: int = RANGE_DIGITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Decide how many words of each document the mix takes.

    Returns the columns of ``docs`` (but for any that are named like an added
    one) with ``size``, ``source_size``, ``target`` and ``taken``.

    Defined cases: a null text has size 0; null sources form one source, last;
    a null id hashes as the empty text; repeated rows share a key and are cut in
    an order fixed by their id and text; a source of size 0 has target 0; an
    empty table gives an empty table.  At more than some 10^8 documents a source,
    raise ``range_digits``.
    """
    base = without(docs, *_ADDED, "_source", "_range", "_key")
    tie = F.xxhash64(F.col(text_col))
    base = base.withColumns({
        "size": word_count(F.col(text_col)),
        "_source": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")),
        "_key": mix_key(F.col(id_col), seed),
    }).withColumn("_range", F.substring("_key", 1, range_digits))

    ranges = materialize(base.groupBy("_source", "_range", F.col(source_col).cast("string").alias("source")).agg(F.sum("size").alias("_range_size")), "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_range_size").alias("source_size")), weights, max_epochs)
    targets = targets.withColumn("_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    in_order = Window.partitionBy("_source").orderBy("_range")
    starts = ranges.drop("source").withColumn("_before", F.sum("_range_size").over(in_order) - F.col("_range_size")).join(targets, "_source")

    inside = Window.partitionBy("_source", "_range").orderBy("_key", F.col(id_col), "size", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = base.join(starts.drop("_range_size"), ["_source", "_range"]).withColumn("_before", F.col("_before") + F.sum("size").over(inside) - F.col("size"))
    budget = F.round("target").cast("long")
    epochs = F.coalesce(F.expr("cast(round(target) as bigint) div nullif(source_size, 0)"), F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    kept = [c for c in base.columns if c not in ("_source", "_range", "_key", "size")]
    return placed.select(*kept, "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))


def realize(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of the mix itself: one per copy taken, the last one cut after its last taken word.

    Only the document on its source's cut is shortened.  The added columns go;
    documents of which nothing is taken, such as those without words, go too.
    """
    whole = F.expr("taken div nullif(size, 0)")
    part = F.col("taken") % F.nullif(F.col("size"), F.lit(0))
    copies = F.coalesce(whole + F.when(part > 0, 1).otherwise(0), F.lit(0))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD_PATTERN), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, part.cast("int")), "")
    rows = mixed.filter(F.col("taken") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    rows = rows.withColumn(text_col, F.when(F.col("_copy") > whole, cut).otherwise(F.col(text_col)))
    return rows.drop("_copy", *_ADDED)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k, hash(text) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS tot,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
         sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
  FROM s
), c AS (SELECT *, cap * a <= w * (tot - b) AS capped FROM r),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap ELSE w * (tot - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0) END AS target
  FROM c
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size, d.h ROWS UNBOUNDED PRECEDING) - d.size AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (coalesce(budget // nullif(source_size, 0), 0) * size
        + greatest(0, least(size, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size - b)))::BIGINT AS taken
FROM p
"""
