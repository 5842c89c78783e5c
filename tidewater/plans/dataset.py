"""From samples and annotated sessions to the labelled candidate table, and the experiment on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, hybrid, matching, smoothing
from ..sources.sessions import CANDIDATE_COLUMNS
from . import analysis


def candidate_rows(samples: DataFrame, sessions: DataFrame, intervals: DataFrame, tolerance: float = matching.TOLERANCE_S, adaptive: bool = True) -> DataFrame:
    """The labelled candidates of every session, in the columns of ``CANDIDATE_COLUMNS`` and with ``item``, their place in the session.

    ``sessions``: ``session_id, recording_id, recording_filename, participant_id,
    exercise, side, weight`` and ``confidence``, that of the annotations as a
    whole; ``intervals``: the verified ``session_id, rep_number, start_time,
    end_time, confidence``.  A candidate is true if it is the one matched to a
    boundary between two verified repetitions; what it is matched to is null for
    the others.  A boundary without a confidence has that of its session.
    """
    signal = analysis.smoothed(samples.join(sessions.select("recording_id"), "recording_id", "left_semi"))
    rows = detect.with_limits(signal, analysis.adaptive_thresholds(signal), ("recording_id",)) if adaptive else smoothing.with_thresholds(signal)
    found = hybrid.candidate_features(rows, None).join(sessions, "recording_id")
    boundaries = matching.human_boundaries(intervals)
    matched = matching.match_candidates(found.select("session_id", F.col("item").alias("cand_index"), F.col("candidate_timestamp").alias("time_s")), boundaries, tolerance)
    told = matched.join(boundaries.select("session_id", "boundary_index", "boundary_time", F.col("confidence").alias("_own")), ["session_id", "boundary_index"])
    told = told.select("session_id", F.col("cand_index").alias("item"), "boundary_index", "boundary_time", "error", "_own")
    joined = found.join(told, ["session_id", "item"], "left")
    hit = F.col("boundary_index").isNotNull()
    said = F.coalesce(F.nullif("_own", F.lit("")), F.col("confidence").cast("string"), F.lit(""))
    labelled = joined.withColumns({
        "human_label": F.when(hit, "true_boundary").otherwise("false_boundary"), "matched_human_boundary_timestamp": F.col("boundary_time"), "matching_error": F.col("error"), "matched_boundary_index": F.col("boundary_index"), "annotation_confidence": F.when(hit, said)})
    return labelled.select(*CANDIDATE_COLUMNS, "item")


def eligible(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions that may be exported, and ``session_id, reason`` of the others (see :func:`~tidewater.operators.matching.eligibility`)."""
    judged = matching.eligibility(sessions)
    return judged.filter("reason = 'eligible'").drop("reason"), judged.filter("reason != 'eligible'").select("session_id", "reason")
