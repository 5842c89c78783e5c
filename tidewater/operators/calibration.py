"""Calibration of recordings: statistics, normalisation, grading, and the calibration that fits a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import held_counts
from .smoothing import tail_means

MIN_RANGE = 1.0


def folded(c: Column) -> Column:
    """Metadata as it is compared: trimmed, in lower case, null as empty."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def tail_calibration(samples: DataFrame, value: str = "raw", percent: int = 10) -> DataFrame:
    """Baseline and maximum as the means of the lowest and highest tenth; usable from a range of 1 on."""
    t = tail_means(samples, value, percent)
    span = F.round(F.col("high_mean") - F.col("low_mean"), 9)
    return t.select("recording_id", F.col("low_mean").alias("baseline"), F.col("high_mean").alias("max_flex"), span.alias("signal_range"), (span >= MIN_RANGE).alias("usable"))


def phase_calibration(samples: DataFrame) -> DataFrame:
    """Baseline as the mean of rows in phase ``relaxed`` and maximum of rows in phase ``flexed``."""
    g = samples.groupBy("recording_id").agg(F.avg(F.when(F.col("phase") == "relaxed", F.col("raw"))).alias("baseline"), F.max(F.when(F.col("phase") == "flexed", F.col("raw"))).alias("max_flex"))
    return g.withColumn("signal_range", F.col("max_flex") - F.col("baseline"))


def normalised(value: Column, baseline: Column, span: Column) -> Column:
    """Percent of the calibrated range: never below 0, not capped at 100; 0 for a range under 1."""
    return F.when(span >= MIN_RANGE, F.greatest(F.lit(0.0), (value - baseline) / span * 100)).otherwise(0.0)


def normalise(samples: DataFrame, calibrations: DataFrame, value: str = "raw") -> DataFrame:
    """``activation`` of every sample under its recording's calibration (columns ``recording_id, baseline, signal_range``)."""
    c = calibrations.select("recording_id", F.col("baseline").alias("_b"), F.col("signal_range").alias("_r"))
    return samples.join(c, "recording_id").withColumn("activation", F.round(normalised(F.col(value), F.col("_b"), F.col("_r")), 6)).drop("_b", "_r")


#: Fixed: from which share of samples, or which multiple of the reference, an excess is moderate and severe.
MODERATE, SEVERE = (0.25, 2.0), (0.50, 3.0)


def is_usable() -> Column:
    """Whether a calibration's range is wide enough and it isn't said to be unusable; an unknown ``usable`` counts as usable."""
    return F.coalesce(F.col("usable"), F.lit(True)) & (F.coalesce(F.col("signal_range"), F.lit(0.0)) >= MIN_RANGE)


def signature() -> Column:
    """What has to agree for two calibrations to be the same: source, baseline and range; null for one that is not usable."""
    return F.when(is_usable(), F.struct(F.coalesce("source_csv", F.lit("")).alias("source_csv"), F.round("baseline", 6).alias("baseline"), F.round("signal_range", 6).alias("signal_range")))


def use_of(samples: DataFrame, reps: DataFrame) -> DataFrame:
    """How far the samples of each recording (``activation``, percent of the calibrated range) go above the reference.

    ``max_activation``, and the shares of samples above 100 among all
    (``over_fraction``) and among those of repetitions (``rep_over_fraction``, 0
    without any); a sample on an end that two repetitions share counts for both.
    """
    over, n = (F.col("activation") > 100).cast("int"), F.col("n_held")
    g = held_counts(samples, reps).groupBy("recording_id").agg(F.max("activation").alias("max_activation"), F.avg(over).alias("_all"), F.sum(over * n).alias("_over"), F.sum(n).alias("_held"))
    share = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return g.select("recording_id", "max_activation", share(F.col("_all")).alias("over_fraction"), share(F.try_divide(F.col("_over"), F.col("_held"))).alias("rep_over_fraction"))


def grade(stats: DataFrame) -> DataFrame:
    """Quality of a calibration from its use (:func:`use_of`): ``level``, ``cross_session`` and ``reasons``.

    ``baseline`` is null where there is no calibration.  An excess is mild as soon
    as the peak is above the reference, and moderate or severe by the multiple of
    the reference that the peak reaches or by the larger of the two shares.
    Reasons add up from level to level.  A severe one can't be compared across
    sessions, nor can one that is missing or unusable.
    """
    ratio, over = F.col("max_activation") / 100, F.greatest(F.coalesce("over_fraction", F.lit(0.0)), F.coalesce("rep_over_fraction", F.lit(0.0)))
    missing, mild = F.col("baseline").isNull(), F.coalesce(ratio > 1, F.lit(False))
    reaches = lambda limits: (over >= limits[0]) | F.coalesce(ratio >= limits[1], F.lit(False))
    level = F.when(missing, "missing").when(~is_usable(), "unusable").when(reaches(SEVERE), "severe").when(reaches(MODERATE), "moderate").when(mild, "mild").otherwise("ok")
    graded = ~missing & is_usable()
    reasons = F.array_compact(F.array(
        F.when(missing, "missing calibration"), F.when(~missing & ~is_usable(), "calibration range too small"), F.when(graded & mild, "above the reference"), F.when(graded & reaches(MODERATE), "moderately above"), F.when(graded & reaches(SEVERE), "severely above")))
    return stats.withColumns({"level": level, "cross_session": ~level.isin("missing", "unusable", "severe"), "reasons": reasons})


def questionable(flag: Column, status: Column) -> Column:
    """A calibration that is flagged (true, not merely set) or whose status says so."""
    return flag.eqNullSafe(True) | F.coalesce(status.rlike("questionable|stale"), F.lit(False))


#: Names a setup's id may have, in order of preference.
SETUP_COLUMNS = ("calibration_setup_id", "sensor_setup_id", "setup_id")


def _matching_fields(df: DataFrame) -> list[Column]:
    text = lambda c: F.col(c).cast("string") if c in df.columns else F.lit("")
    setup = first_filled(*[text(c) for c in SETUP_COLUMNS if c in df.columns])
    return [folded(text("muscle")).alias("m"), folded(text("side")).alias("s"), folded(setup).alias("u")]


def newest_compatible(recordings: DataFrame, calibrations: DataFrame, strict: bool = False) -> DataFrame:
    """``recording_id, calibration_id`` of recordings that have a fitting calibration.

    A recording flagged as questionable has none.  One that names its
    calibration (``calibration_csv``, a ``csv_filename`` of ``calibrations``) has
    that one or none.  Any other has the newest with its muscle, side and setup.
    A recording without muscle or side fits with every calibration, whatever its
    setup; in the strict form it has none.  All are equi-joins on the newest
    calibration of each key, and on one row for what fits with every one.
    """
    columns = [F.col("recording_id"), *_matching_fields(recordings)]
    named = "calibration_csv" in recordings.columns and "csv_filename" in calibrations.columns
    if {"calibration_questionable", "calibration_status"} & set(recordings.columns):
        flag, status = (F.col(c) if c in recordings.columns else F.lit(None) for c in ("calibration_questionable", "calibration_status"))
        recordings = recordings.filter(~questionable(flag.cast("boolean"), F.lower(status.cast("string"))))
    r = recordings.select(*columns, (F.coalesce("calibration_csv", F.lit("")) if named else F.lit("")).alias("csv"))
    c = calibrations.select("calibration_id", "mtime", *_matching_fields(calibrations), *(["csv_filename"] if named else []))
    rank, free = F.struct("mtime", "calibration_id"), (F.col("m") == "") | (F.col("s") == "")

    def best(keys: list[str]) -> DataFrame:
        return c.groupBy(*keys).agg(F.max(rank)["calibration_id"].alias("calibration_id"))

    own = r.filter("csv = ''")
    out = own.filter(~free).join(best(["m", "s", "u"]), ["m", "s", "u"]).select("recording_id", "calibration_id")
    if not strict:
        newest = F.broadcast(c.agg(F.max(rank)["calibration_id"].alias("calibration_id")).filter("calibration_id is not null"))  # one row
        out = out.unionByName(own.filter(free).join(newest, F.lit(True)).select("recording_id", "calibration_id"))
    if named:
        file = c.groupBy(F.col("csv_filename").alias("csv")).agg(F.max_by(F.struct("calibration_id", "m", "s", "u"), rank).alias("c"))
        fits = (F.col("m") == F.col("c.m")) & (F.col("s") == F.col("c.s")) & (F.col("u") == F.col("c.u"))
        fits = ~free & fits if strict else free | fits
        out = out.unionByName(r.filter("csv != ''").join(file, "csv").filter(fits).select("recording_id", "c.calibration_id"))
    return out


def saturation(samples: DataFrame, active: str | None = None) -> DataFrame:
    """Percent of samples within ``max(2, 1% of the range)`` of the maximum, over all rows and over active ones."""
    w = Window.partitionBy("recording_id")
    top, low = F.max("raw").over(w), F.min("raw").over(w)
    near = F.col("raw") >= top - F.greatest(F.lit(2.0), (top - low) * 0.01)
    marked = samples.select("recording_id", near.cast("int").alias("near"), (F.col(active) if active else F.lit(None).cast("boolean")).alias("on"))
    share = lambda c: F.round(F.avg(c) * 100, 6)
    return marked.groupBy("recording_id").agg(share("near").alias("near_max_percent"), share(F.when(F.col("on"), F.col("near"))).alias("near_max_active_percent"))
