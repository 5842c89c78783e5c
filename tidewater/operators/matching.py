"""Candidates against human boundaries, annotation checks, splits and scores."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import first_interval, held_points

TOLERANCE_S = 0.25


def human_boundaries(intervals: DataFrame) -> DataFrame:
    """Between consecutive intervals ``start_time, end_time`` of a session: the two facing ends, their middle and the confidence they share or else the first given."""
    w = Window.partitionBy("session_id").orderBy("rep_number")
    rows = intervals.withColumns({"_start": F.lead("start_time").over(w), "_conf": F.lead("confidence").over(w)}).filter(F.col("_start").isNotNull())
    conf = F.coalesce(F.nullif(F.col("confidence"), F.lit("")), F.nullif(F.col("_conf"), F.lit("")), F.lit(""))
    number = F.row_number().over(w).cast("long")
    return rows.select("session_id", number.alias("boundary_index"), F.least("end_time", "_start").alias("lo"), F.greatest("end_time", "_start").alias("hi"), F.round((F.col("end_time") + F.col("_start")) / 2, 6).alias("boundary_time"), conf.alias("confidence"))


def reach_components(boundaries: DataFrame, tolerance: float) -> DataFrame:
    """``boundaries`` with ``component``: those whose reach, their span and ``tolerance`` either way, overlaps are in one."""
    w = Window.partitionBy("session_id").orderBy("lo", "hi", "boundary_index")
    far = F.max(F.col("hi") + tolerance).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("lo") - tolerance <= far, 0).otherwise(1)
    return boundaries.withColumn("_fresh", fresh).withColumn("component", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_fresh")


def match_candidates(candidates: DataFrame, boundaries: DataFrame, tolerance: float = TOLERANCE_S) -> DataFrame:
    """One-to-one assignment of candidates (``cand_index, time_s``) to boundaries, nearest first.

    The error is the distance from the candidate to the boundary's span.  Pairs
    within the tolerance are put in order of error, distance to the middle, times
    and places, and are taken while both sides are free.  Pairs can only compete
    within one component of overlapping reaches, so each is decided by itself:
    a sweep finds the component of every candidate, and the greedy pass folds the
    few pairs of a component, never those of a session.
    """
    marked = reach_components(boundaries.select("session_id", "boundary_index", "lo", "hi", "boundary_time"), tolerance)
    slack = tolerance + 1e-6  # ends count, whatever the last digits of a sum
    spans = marked.groupBy("session_id", "component").agg((F.min("lo") - slack).alias("start_time"), (F.max("hi") + slack).alias("end_time"))
    near = held_points(candidates.select("session_id", "cand_index", "time_s"), spans, ("session_id",)).drop("start_time", "end_time")
    error = F.greatest(F.lit(0.0), F.col("lo") - F.col("time_s"), F.col("time_s") - F.col("hi"))
    pairs = near.join(marked, ["session_id", "component"]).withColumns({"error": F.round(error, 6), "off": F.round(F.abs(F.col("time_s") - F.col("boundary_time")), 6)}).filter(F.col("error") <= tolerance)
    entry = F.struct("error", "off", "time_s", "boundary_time", "cand_index", "boundary_index")
    kind = "array<struct<cand_index:bigint,boundary_index:bigint,error:double>>"
    take = lambda acc, p: F.when(
        F.exists(acc, lambda x: (x["cand_index"] == p["cand_index"]) | (x["boundary_index"] == p["boundary_index"])), acc
    ).otherwise(F.concat(acc, F.array(F.struct(p["cand_index"].cast("long").alias("cand_index"), p["boundary_index"].cast("long").alias("boundary_index"), p["error"].alias("error")))))
    folded = pairs.groupBy("session_id", "component").agg(F.array_sort(F.collect_list(entry)).alias("p")).select("session_id", F.aggregate("p", F.array().cast(kind), take).alias("m"))
    return folded.select("session_id", F.explode("m").alias("m")).select("session_id", "m.cand_index", "m.boundary_index", "m.error")


def first_region(points: DataFrame, regions: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """The first region (by ``region_no``) whose closed span holds each point, with its bounds; null where none does.

    With ``whole`` (``recording_id, start_time, end_time``) a point outside all
    regions has the bounds of its recording.
    """
    return first_interval(points.select("recording_id", "seq", "time_s"), regions.select("recording_id", "region_no", "start_time", "end_time"), "region_no", whole=whole)


def annotation_errors(annotations: DataFrame, max_time: str = "max_time") -> DataFrame:
    """Per session the errors of its rows: numbers that don't run from 1, times that are no numbers (the row is then skipped), order, range and overlap."""
    w = Window.partitionBy("session_id").orderBy("row_no")
    t = annotations.withColumns({"s": F.col("start_time").try_cast("double"), "e": F.col("end_time").try_cast("double"), "n": F.row_number().over(w)})
    known = F.col("s").isNotNull() & F.col("e").isNotNull()
    before = F.last(F.when(known, F.col("e")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumns({"known": known, "before": before})
    at = lambda text: F.concat(F.lit("row "), F.col("n").cast("string"), F.lit(f": {text}"))
    said = F.array_compact(F.array(
        F.when(~F.col("rep_number").eqNullSafe(F.col("n")), at("number out of order")), F.when(~F.col("known"), at("time is no number")), F.when(F.col("known") & (F.col("s") >= F.col("e")), at("start not before end")),
        F.when(F.col("known") & ((F.col("s") < 0) | (F.col("e") > F.col(max_time))), at("outside the recording")), F.when(F.col("known") & (F.col("s") < F.col("before")), at("overlaps the one before"))))
    g = t.withColumn("said", said).groupBy("session_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda x: x["said"])).alias("errors"), F.count_if(F.col("known")).alias("rows_kept"))
    return g.select("session_id", "rows_kept", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", "; ").alias("errors"))


def eligibility(sessions: DataFrame) -> DataFrame:
    """The first reason why a session can't be exported, or ``eligible``."""
    reason = F.coalesce(
        F.when(F.coalesce(F.col("participant_id"), F.lit("")) == "", "missing manifest field"), F.when(F.col("annotation_status").isNull(), "missing annotations"), F.when(F.col("annotation_status") != "locked", "annotations not locked"),
        F.when(~F.coalesce(F.col("has_csv"), F.lit(False)), "missing recording"), F.when(F.col("n_errors") > 0, "invalid annotations"), F.when(F.col("n_reps") == 0, "no repetitions"), F.lit("eligible"))
    return sessions.withColumn("reason", reason)


def split_groups(rows: DataFrame, group: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole groups into ``train`` and ``test``: sorted groups are shuffled by a seed and ``round(n * fraction)`` (half to even, at least one on either side) are the test part.

    The groups of a data set are participants or sessions, a list that people
    have entered; only that list is shuffled on the driver.  For groups without
    such a bound use :func:`hash_split`.
    """
    names = [r[0] for r in rows.select(group).filter(F.col(group).isNotNull()).distinct().orderBy(group).collect()]
    if len(names) < 2:
        raise ValueError("at least two groups are needed for a split")
    random.Random(seed).shuffle(names)
    n = max(1, min(len(names) - 1, round(len(names) * test_fraction)))
    return rows.withColumn("part", F.when(F.col(group).isin(names[:n]), "test").otherwise("train"))


def hash_split(rows: DataFrame, group: str, test_percent: int = 20, seed: str = "split") -> DataFrame:
    """Whole groups into parts by a hash of their name: the same in any engine, without a list of groups."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(group).cast("string")).cast("binary")), 1, 6), 16, 10).cast("long") % 100
    return rows.withColumn("part", F.when(h < test_percent, "test").otherwise("train"))


def leaks(split: DataFrame, group: str) -> DataFrame:
    """Groups that lie in more than one part; none in a sound split."""
    return split.groupBy(group).agg(F.count_distinct("part").cast("long").alias("parts")).filter("parts > 1")


def confusion(scored: DataFrame, truth: Column, predicted: Column, *keys: str) -> DataFrame:
    """Counts and rates of a binary prediction; empty denominators give 0."""
    n = lambda c: F.count_if(c).cast("long")
    g = scored.groupBy(*keys).agg(n(truth & predicted).alias("tp"), n(~truth & predicted).alias("fp"), n(truth & ~predicted).alias("fn"), n(~truth & ~predicted).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return g.select(*keys, "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(k) for k, c in (("precision", p), ("recall", r), ("f1", f1), ("accuracy", ratio(tp + tn, tp + fp + fn + tn)))])


def ranking_scores(scored: DataFrame, truth: Column, score: Column, key: str) -> DataFrame:
    """ROC AUC (ties count half) and average precision per key, from counts by distinct score; keys that lack a class give none."""
    by = scored.groupBy(key, score.alias("_s")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("q"))
    down, whole = Window.partitionBy(key).orderBy(F.desc("_s")), Window.partitionBy(key)
    t = by.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("q").over(down), "all_p": F.sum("p").over(whole), "all_q": F.sum("q").over(whole)})
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / F.max(F.col("all_p") * F.col("all_q"))
    average = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("all_p")
    return t.filter("all_p > 0 and all_q > 0").groupBy(key).agg(F.round(area, 6).alias("roc_auc"), F.round(average, 6).alias("average_precision"))
