"""End-to-end plans: from samples to repetitions, summaries and comparisons of many recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration, detect, hybrid, metrics, smoothing

#: A prefix that finds more repetitions is still refused if its first one begins so much earlier.
EARLIER_S = 0.25


def smoothed(samples: DataFrame) -> DataFrame:
    return smoothing.centered_average(samples)


def full_thresholds(signal: DataFrame) -> DataFrame:
    return smoothing.thresholds(signal)


def adaptive_thresholds(signal: DataFrame) -> DataFrame:
    """Thresholds of the whole recording, or of its active prefix where that lets either detector find more.

    Both detectors run under both sets of thresholds; the whole recording's stay
    unless the prefix is shorter and finds more repetitions, and does not put the
    first one earlier by more than ``EARLIER_S``.
    """
    full, prefix = smoothing.thresholds(signal), smoothing.thresholds(smoothing.active_prefix(signal))
    j = full.withColumn("n", F.col("reference_count")).join(prefix.select("recording_id", F.col("reference_count").alias("m"), F.struct(*full.columns).alias("_prefix")), "recording_id")
    # what the prefix finds is asked for where it is shorter only
    for name, rows in (("full", smoothing.with_thresholds(signal)), ("prefix", smoothing.with_prefix_thresholds(signal))):
        found = hybrid.detect(rows, None, kinds=(hybrid.THRESHOLD, "rep"))
        valley = F.col("kind") == "rep"
        counts = found.groupBy("recording_id").agg(F.count_if(~valley).alias(f"{name}_legacy"), F.count_if(valley).alias(f"{name}_hybrid"), F.min(F.when(valley, F.col("start_time"))).alias(f"{name}_first"))
        j = j.join(counts, "recording_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    more = (zero("prefix_legacy") > zero("full_legacy")) | (zero("prefix_hybrid") > zero("full_hybrid"))
    early = F.coalesce(F.col("prefix_first") < F.col("full_first") - EARLIER_S, F.lit(False))
    use = j.withColumn("use_prefix", (F.col("m") < F.col("n")) & more & ~early)
    return use.select("recording_id", *[F.when(F.col("use_prefix"), F.col(f"_prefix.{c}")).otherwise(F.col(c)).alias(c) for c in full.columns if c != "recording_id"], "use_prefix")


def repetitions(samples: DataFrame, adaptive: bool = False) -> DataFrame:
    """Measured repetitions of every recording by the threshold detector."""
    signal = smoothed(samples)
    rows = detect.with_limits(signal, adaptive_thresholds(signal), ("recording_id",)) if adaptive else smoothing.with_thresholds(signal)
    return detect.shown(detect.measured_reps(rows))


def summaries(samples: DataFrame, adaptive: bool = False) -> DataFrame:
    """How many repetitions each recording has, how long its set is, how its peak falls."""
    return detect.set_summary(repetitions(samples, adaptive), samples)


def normalised_summaries(samples: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Mean and peak activation, in percent of the calibrated range, of the repetitions of each recording that has a usable calibration.

    Repetitions are found on the raw signal; each one's mean counts once,
    ``norm_peak`` is the highest of all, ``norm_avg_peak`` their mean.
    """
    usable = calibrations.filter(calibration.is_usable())
    rows = calibration.normalise(smoothing.with_thresholds(smoothed(samples)), usable)
    m = detect.measured_reps(rows).groupBy("recording_id").agg(
        detect.steady_mean("norm_mean_value").alias("norm_avg_value"), F.max("norm_peak_value").alias("norm_peak"), detect.steady_mean("norm_peak_value").alias("norm_avg_peak"), F.sum("norm_integral").alias("norm_integral"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return usable.select("recording_id").join(m, "recording_id", "left").select("recording_id", *[zero(c) for c in ("norm_avg_value", "norm_peak", "norm_avg_peak", "norm_integral")])


def calibrated_rows(samples: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Smoothed samples with thresholds, and with ``activation`` where their recording has a usable calibration, null elsewhere."""
    usable = calibrations.filter(calibration.is_usable()).select("recording_id", F.col("baseline").alias("_b"), F.col("signal_range").alias("_r"))
    rows = smoothing.with_thresholds(smoothed(samples)).join(usable, "recording_id", "left")
    return rows.withColumn("activation", F.when(F.col("_r").isNotNull(), F.round(calibration.normalised(F.col("raw"), F.col("_b"), F.col("_r")), 6))).drop("_b", "_r")


def recording_facts(samples: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Extremes and length of every recording, and whether its calibration is usable."""
    span = F.round(F.max_by("time_s", "seq") - F.min_by("time_s", "seq"), 6)
    g = samples.groupBy("recording_id").agg(F.min("raw").alias("raw_min"), F.max("raw").alias("raw_max"), span.alias("recording_duration"))
    usable = calibrations.filter(calibration.is_usable()).select("recording_id", F.lit(True).alias("_usable"))
    return g.join(usable, "recording_id", "left").select(*g.columns, F.coalesce("_usable", F.lit(False)).alias("calibration_usable"))


def set_analysis(samples: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Every recording with its set's metrics, raw and normalised (:func:`~tidewater.operators.metrics.set_metrics`).

    ``calibrations``: ``recording_id, baseline, signal_range, usable``, at most
    one row a recording; thresholds are those of the whole recording.
    """
    measured = detect.measured_reps(calibrated_rows(samples, calibrations))
    return metrics.set_metrics(measured, recording_facts(samples, calibrations))


def calibration_quality(samples: DataFrame, calibrations: DataFrame) -> DataFrame:
    """How well each recording's calibration suits it: level, reasons, whether it may be compared across sessions, and its signature.

    Besides the columns of :func:`set_analysis`, ``calibrations`` have ``source_csv``.
    """
    rows = calibrated_rows(samples, calibrations)
    use = calibration.use_of(rows, detect.detect(rows))
    graded = calibration.grade(use.join(calibrations, "recording_id", "left"))
    return graded.withColumn("signature", calibration.signature())


def valley_detection(samples: DataFrame) -> DataFrame:
    """Repetitions, candidates and quality rows of the valley detector."""
    return hybrid.detect(smoothing.with_thresholds(smoothed(samples)), None)
