"""What is told about a set: the facts of every recording, and the lines of its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import detect
from . import analysis

#: Fixed: metadata that a report shows, in order, and their labels.
METADATA_LABELS = {
    "csv_filename": "CSV filename", "timestamp": "Timestamp", "exercise_name": "Exercise", "muscle": "Muscle", "side": "Side", "weight": "Weight", "expected_reps": "Expected reps",
    "calibration_setup_id": "Calibration setup ID", "data_type": "Data type", "test_type": "Test type", "notes": "Notes",
}
#: Changes of at most so many percent are none; falls from the second limit on may be fatigue.
SMALL_CHANGE, FATIGUE = 5.0, 15.0
#: A normalised peak over this asks for another calibration.
RECALIBRATE_OVER = 110.0


def facts(samples: DataFrame, calibrations: DataFrame) -> DataFrame:
    """The columns of :func:`~tidewater.operators.detect.set_summary` with means and peaks of the whole recording, of both halves of the set and in percent of the calibrated range.

    ``norm_*`` are null without a usable calibration; with one, a recording
    without repetitions has zeros.  The first half has ``n div 2`` repetitions.
    """
    rows = analysis.calibrated_rows(samples, calibrations)
    measured = detect.measured_reps(rows)
    shown = detect.shown(measured)
    first = F.col("rep_no") <= F.floor(F.count(F.lit(1)).over(Window.partitionBy("recording_id")) / 2)
    reps = measured.withColumn("_first", first).groupBy("recording_id").agg(
        detect.steady_mean("mean_activation").alias("avg_activation"), detect.steady_mean(F.when(F.col("_first"), F.col("peak_value"))).alias("first_half_peak"), detect.steady_mean(F.when(~F.col("_first"), F.col("peak_value"))).alias("second_half_peak"),
        detect.steady_mean("norm_mean_value").alias("_reps"), F.max("norm_peak_value").alias("_peak"))
    whole = rows.groupBy("recording_id").agg(F.round(detect.steady_mean("raw"), 6).alias("overall_avg"), F.round(F.max("raw"), 6).alias("overall_peak"), F.round(detect.steady_mean("activation"), 6).alias("norm_overall"))
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6)
    told = whole.join(reps, "recording_id", "left").select(
        "recording_id", "overall_avg", "overall_peak", "norm_overall", *[zero(c).alias(c) for c in ("avg_activation", "first_half_peak", "second_half_peak")],
        *[F.when(F.col("norm_overall").isNotNull(), zero(c)).alias(f"norm{c}") for c in ("_reps", "_peak")])
    return detect.set_summary(shown, samples).join(told, "recording_id")


def change_words(fall: Column) -> Column:
    """A fall in percent (negative: a rise) in words."""
    return F.when(F.abs(fall) <= SMALL_CHANGE, "hardly any").when(fall > 0, F.format_string("down %.1f%%", fall)).otherwise(F.format_string("up %.1f%%", -fall))


def metadata_lines(metadata: Column) -> Column:
    """A heading and a line for each known field that is not empty; none for null or an empty map."""
    lines = F.array(*[F.when(metadata[k] != "", F.concat(F.lit(f"{label}: "), metadata[k])) for k, label in METADATA_LABELS.items()])
    return F.when(F.size(metadata) > 0, F.concat(F.array(F.lit("Metadata")), F.array_compact(lines))).otherwise(F.array().cast("array<string>"))


def set_lines() -> Column:
    """The set in numbers."""
    n = lambda label, c, form="%.1f": F.format_string(f"{label}: {form}", c)
    lines = [
        F.lit("Set"), n("Repetitions", "rep_count", "%d"), n("Length", "set_duration", "%.2f s"), n("Mean signal", "overall_avg"), n("Peak signal", "overall_peak"), n("Mean repetition length", "avg_duration", "%.2f s"),
        n("Mean repetition peak", "avg_peak"), n("Mean repetition activation", "avg_activation"), n("Mean peak of the first half", "first_half_peak"), n("Mean peak of the second half", "second_half_peak"),
        F.concat(F.lit("Change of activation between halves: "), change_words(F.col("peak_drop"))), F.concat(F.lit("Possible fatigue: "), F.when(F.col("possible_fatigue"), "yes").otherwise("no")),
    ]
    known = F.col("norm_overall").isNotNull()
    scaled = [F.lit("Of the calibrated range"), n("Mean of the recording", "norm_overall", "%.1f%%"), n("Mean of the repetitions", "norm_reps", "%.1f%%"), n("Peak", "norm_peak", "%.1f%%")]
    return F.array_compact(F.array(*lines, *[F.when(known, x) for x in scaled]))


def insight_lines() -> Column:
    """The set in sentences."""
    fall, known = F.col("peak_drop"), F.col("norm_overall").isNotNull()
    tired = F.when(fall >= FATIGUE, "Later repetitions were clearly weaker; fatigue is possible.").when(fall > SMALL_CHANGE, "Later repetitions were somewhat weaker.").when(fall < -SMALL_CHANGE, "Later repetitions were stronger.").otherwise("Activation held through the set.")
    lines = [
        F.lit("Insights"), F.format_string("%d repetitions done.", "rep_count"), F.when(F.col("rep_count") > 0, F.format_string("Repetition %d was the strongest.", "strongest_rep")).otherwise("Without repetitions none is the strongest."),
        F.concat(F.lit("From half to half activation changed: "), change_words(fall), F.lit(".")), tired,
        F.when(known, F.format_string("Repetitions took %.1f%% of the calibrated range on average.", "norm_reps")).otherwise("There is no usable calibration, so nothing is normalised."),
        F.when(known, F.format_string("With the rests it was %.1f%%.", "norm_overall")), F.when(known, F.format_string("The peak was %.1f%%.", "norm_peak")),
        F.when(F.col("norm_peak") > RECALIBRATE_OVER, "That is well over the calibrated range: calibrate again."),
    ]
    return F.array_compact(F.array(*lines))


def set_report(told: DataFrame, metadata: DataFrame) -> DataFrame:
    """``recording_id, report``: metadata, numbers and sentences of every recording in :func:`facts`, in parts with an empty line between them."""
    rows = told.join(metadata.select("recording_id", "metadata"), "recording_id", "left")
    parts = [F.nullif(F.array_join(lines, "\n"), F.lit("")) for lines in (metadata_lines(F.col("metadata")), set_lines(), insight_lines())]
    return rows.select("recording_id", F.concat_ws("\n\n", *parts).alias("report"))
