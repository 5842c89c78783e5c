"""Connected components of a table of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``links``; the label is the smallest node of its component.

    Large-star and small-star steps in turn: each keeps the components and
    brings every node nearer to the smallest one, until every node is linked to
    that alone, in a number of rounds that grows with the logarithm of the longest
    chain.  Every round is cut by a table in the shared folder.  An empty table
    gives none; if stars are not reached in ``max_rounds``, which no chain of less
    than ``2^max_rounds`` nodes needs, an error is raised rather than a wrong label given.
    """
    def clean(e: DataFrame) -> DataFrame:
        return e.filter(F.col("u") != F.col("v")).distinct()

    edges = materialize(clean(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), "links")
    for _ in range(max_rounds):
        # large star: larger neighbours are linked to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = clean(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: a node and its smaller neighbours are linked to the smallest of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(lower, "u")
        small = clean(pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v"))))
        new = materialize(small, "links")
        discard(edges)
        edges = new
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))).alias("e")).select("e.*")
        roles = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("all"))
        if not roles.filter("down > 1 or down = 1 and all > 1").limit(1).count():
            break
    else:
        raise RuntimeError(f"no stars after {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return stars.unionByName(roots.join(stars.select("node"), "node", "left_anti").withColumn("label", F.col("node")))
