"""Warnings about recordings, annotations and time stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import annotation_errors

#: Fixed: limits of the signal's range and of the share of samples near the maximum.
FLAT_RANGE, SMALL_RANGE, NEAR_MAX_PERCENT, NEAR_MAX_ACTIVE_PERCENT = 2.0, 20.0, 3.0, 8.0
#: Fixed: a ratio of the largest times beyond which two tables have different units.
UNIT_RATIO = 100.0


def recording_warnings(rows: DataFrame) -> DataFrame:
    """``warnings`` of each recording, as codes in a fixed order.

    Columns: ``signal_range``, ``expected_reps`` (text, empty if unknown),
    ``detected_reps``, ``has_calibration``, ``calibration_side``,
    ``required_side``, ``graph_mtime``, ``summary_mtime``, ``is_excluded``,
    ``near_max_percent``, ``near_max_active_percent``; all may be null.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    side = (text("required_side") != "") & (text("calibration_side") != "") & (text("required_side") != text("calibration_side"))
    codes = (
        F.when(F.coalesce("signal_range", F.lit(0.0)) <= FLAT_RANGE, "flat_signal").when(F.col("signal_range") <= SMALL_RANGE, "small_range"),
        F.when((text("expected_reps") != "") & (text("expected_reps") != text("detected_reps")), "rep_count_differs"),
        F.when(~yes(F.col("has_calibration")), "no_calibration").when(side, "calibration_of_other_side"),
        F.when(F.col("graph_mtime").isNull(), "no_graph").when(F.col("graph_mtime") < F.col("summary_mtime"), "graph_older_than_summary"),
        F.when(yes(F.col("is_excluded")), "diagnostic_or_excluded"),
        F.when(yes(F.col("near_max_percent") >= NEAR_MAX_PERCENT) | yes(F.col("near_max_active_percent") >= NEAR_MAX_ACTIVE_PERCENT), "saturated"),
    )
    return rows.withColumn("warnings", F.array_compact(F.array(*codes)))


def payload_errors(sessions: DataFrame, reps: DataFrame, false_intervals: DataFrame) -> DataFrame:
    """``session_id, n_errors, errors`` of whole annotations.

    ``sessions``: ``session_id, max_time, actual_reps`` (text).  ``reps`` and
    ``false_intervals``: rows as :func:`~.matching.annotation_errors` takes them,
    without ``max_time``; numbers of false intervals don't matter.  A count that
    is set has to be a whole number and that of the rows with times; 0 is not unset.
    """
    limit = sessions.select("session_id", "max_time")
    of_reps = annotation_errors(reps.join(limit, "session_id"))
    order = F.row_number().over(Window.partitionBy("session_id").orderBy("row_no")).cast("long")
    of_false = annotation_errors(false_intervals.withColumn("rep_number", order).join(limit, "session_id"))
    false_text = F.when(F.col("false_errors") != "", F.concat(F.lit("false intervals: "), F.col("false_errors")))
    j = sessions.join(of_reps.withColumnRenamed("n_errors", "r"), "session_id", "left").join(of_false.select("session_id", F.col("n_errors").alias("f"), F.col("errors").alias("false_errors")), "session_id", "left")
    whole = F.when(F.trim("actual_reps").rlike(r"^[+-]?\d+$"), F.trim("actual_reps").try_cast("long"))
    count = F.when(F.col("actual_reps").isNotNull(), F.when(whole.isNull(), "actual_reps is no whole number").when(whole != F.coalesce("rows_kept", F.lit(0)), "actual_reps differs from the rows"))
    said = F.array_compact(F.array(F.nullif(F.col("errors"), F.lit("")), false_text, count))
    n = F.coalesce("r", F.lit(0)) + F.coalesce("f", F.lit(0)) + count.isNotNull().cast("long")
    return j.select("session_id", n.cast("long").alias("n_errors"), F.array_join(said, "; ").alias("errors"))


def apply_updates(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """What becomes of annotations under updates (``session_id, kind, reason, new_status``): ``session_id, outcome, annotation_status``.

    ``kind`` is ``save``, ``override`` or ``unlock``.  A locked row takes no plain
    save; the others need a reason, and unlocking makes a row ``reviewed``.
    """
    j = updates.join(existing.select("session_id", F.col("annotation_status").alias("_old")), "session_id", "left")
    reason = F.coalesce(F.col("reason"), F.lit("")) != ""
    outcome = F.when(F.col("kind") == "save", F.when(F.col("_old").eqNullSafe("locked"), "locked").otherwise("saved")).when(~reason, "no reason").otherwise("saved")
    after = F.when(outcome != "saved", F.coalesce("_old", F.lit("unreviewed"))).when(F.col("kind") == "unlock", "reviewed").otherwise(F.col("new_status"))
    return j.select("session_id", outcome.alias("outcome"), after.alias("annotation_status"))


def unit_warnings(candidates: DataFrame, boundaries: DataFrame, matched: DataFrame) -> DataFrame:
    """``session_id, ratio`` of sessions without a single match whose largest times are so far apart that their units must differ."""
    c = candidates.groupBy("session_id").agg(F.max("time_s").alias("c"))
    b = boundaries.groupBy("session_id").agg(F.max("boundary_time").alias("b"))
    j = c.join(b, "session_id").join(matched.select("session_id").distinct(), "session_id", "left_anti").filter("c > 0 and b > 0")
    ratio = F.col("c") / F.col("b")
    return j.filter((ratio > UNIT_RATIO) | (ratio < 1 / UNIT_RATIO)).select("session_id", F.round(ratio, 6).alias("ratio"))


def z_scores(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` less their mean over their population deviation; a deviation of 0 counts as 1."""
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_d_{c}") for c in columns])  # one row
    score = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_d_{c}") == 0, 1.0).otherwise(F.col(f"_d_{c}"))
    return rows.join(F.broadcast(stats), F.lit(True)).select(*[score(c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def half_even(c: Column, digits: int = 4) -> Column:
    """Rounded to ``digits``, ties to the even one."""
    return F.bround(c, digits)
