"""The threshold detector of repetitions, and what is measured inside them.

Only the rows where the signal crosses a threshold can change the detector's
state, so each recording is reduced to those few rows first and folded with a
higher-order function; the samples themselves are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import held_points

MIN_DURATION_S, MIN_GAP_S = 0.35, 0.25
#: An opening repetition is dropped if it falls short of all three shares of the others' medians.
TRANSIENT = {"duration": 0.55, "area": 0.35, "peak_excess": 0.55}

_STATE = "struct<inside:boolean,start:double,until:double,reps:array<struct<start_time:double,end_time:double>>>"


def steady_mean(c: Column | str) -> Column:
    """A mean whose sum is rounded, so that the order in which rows arrive can't show in its last digits."""
    return F.round(F.sum(c), 6) / F.count(c)


def with_limits(smoothed: DataFrame, limits: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """``smoothed`` with the thresholds of its recordings; without ``limits`` it has them already."""
    return smoothed if limits is None else smoothed.drop("start_threshold", "end_threshold").join(limits.select(*keys, "start_threshold", "end_threshold"), list(keys))


def _edges(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("seq")
    rows = rows.withColumns({"_before": F.lag("smooth").over(w), "_next": F.lead("seq").over(w)})
    first, cur, before = F.col("_before").isNull(), F.col("smooth"), F.col("_before")
    up = F.when(first, cur >= F.col("start_threshold")).otherwise((before <= F.col("start_threshold")) & (cur > F.col("start_threshold")))
    low = cur <= F.col("end_threshold")
    down = low & (first | (before > F.col("end_threshold")) | up)
    last = F.col("_next").isNull()
    return rows.select(*keys, "seq", "time_s", up.alias("up"), down.alias("down"), last.alias("last")).filter("up or down or last")


def _step(state: Column, e: Column) -> Column:
    arm = ~state["inside"] & e["up"] & (state["until"].isNull() | (F.round(e["time_s"], 6) >= F.round(state["until"], 6)))
    start = F.when(arm, e["time_s"]).otherwise(state["start"])
    inside = state["inside"] | arm
    ends = inside & (e["down"] | e["last"])
    good = ends & (F.round(e["time_s"] - start, 6) >= MIN_DURATION_S)
    return F.struct(
        (inside & ~ends).alias("inside"), start.alias("start"), F.when(good, e["time_s"] + MIN_GAP_S).otherwise(state["until"]).alias("until"),
        F.when(good, F.concat(state["reps"], F.array(F.struct(start.alias("start_time"), e["time_s"].alias("end_time"))))).otherwise(state["reps"]).alias("reps"),
    ).cast(_STATE)


def threshold_reps(smoothed: DataFrame, limits: DataFrame | None, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """``rep_no, start_time, end_time`` of each recording.

    A repetition opens where the signal rises over the start threshold (or opens
    the recording at it) and closes at the end threshold or the last row.  It
    counts from ``MIN_DURATION_S`` on; after one that counts, rises within
    ``MIN_GAP_S`` are not heard.
    """
    events = _edges(with_limits(smoothed, limits, keys), keys)
    start = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("until"), F.array().alias("reps")).cast(_STATE)
    folded = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "time_s", "up", "down", "last"))).alias("e"))
    reps = folded.select(*keys, F.aggregate("e", start, _step)["reps"].alias("reps"))
    return reps.select(*keys, F.posexplode("reps").alias("p", "r")).select(*keys, (F.col("p") + 1).cast("long").alias("rep_no"), "r.start_time", "r.end_time")


def samples_in_reps(samples: DataFrame, reps: DataFrame, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Samples with the repetitions that hold them; both bounds belong to a repetition."""
    return held_points(samples, reps, keys)


def measure(rows: DataFrame, reps: DataFrame, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """What there is to tell of every repetition, in one sweep over its samples.

    Of ``raw``: mean, median, peak, the first time of the peak, the trapezoid
    integral and ``mean_activation``, the integral over the duration.  Of
    ``activation``, if ``rows`` have it, the same but for the time.  Of ``smooth``
    and ``start_threshold`` what the rejection of opening transients looks at.
    """
    w = Window.partitionBy(*keys, "rep_no").orderBy("seq")
    inside = held_points(rows, reps, keys).withColumn("_dt", F.col("time_s") - F.lag("time_s").over(w))
    span, n = F.col("end_time") - F.col("start_time"), F.count(F.lit(1))
    sums, out = [n.cast("long").alias("n_samples"), F.min_by("time_s", F.struct(-F.col("raw"), F.col("seq"))).alias("peak_time")], {}
    for value, prefix in (("raw", ""), ("activation", "norm_")):
        if value not in rows.columns:
            continue
        inside = inside.withColumn(f"_{prefix}pair", (F.col(value) + F.lag(value).over(w)) / 2)
        sums += [
            steady_mean(value).alias(f"_{prefix}mean"), F.median(value).alias(f"_{prefix}median"), F.max(value).alias(f"_{prefix}peak"), F.sum(F.when(F.col("_dt") > 0, F.col(f"_{prefix}pair") * F.col("_dt"))).alias(f"_{prefix}area"),
        ]
        area = F.when(span <= 0, 0.0).when(F.col("n_samples") == 1, F.col(f"_{prefix}mean") * span).otherwise(F.coalesce(F.col(f"_{prefix}area"), F.lit(0.0)))
        names = ("mean_value", "median_value", "peak_value", "integral", "mean_activation")
        out |= dict(zip([prefix + x for x in names], (F.col(f"_{prefix}mean"), F.col(f"_{prefix}median"), F.col(f"_{prefix}peak"), area, F.when(span > 0, F.round(area, 6) / span).otherwise(0.0))))
    evidence = []
    if {"smooth", "start_threshold"} <= set(rows.columns):
        over = F.col("smooth") - F.col("start_threshold")
        sums += [F.max(over).alias("_excess"), F.sum(F.greatest(F.lit(0.0), over)).alias("_above")]
        step = F.when(F.col("n_samples") > 1, span / (F.col("n_samples") - 1)).otherwise(0.0)
        evidence = [F.round("_excess", 9).alias("peak_excess"), F.round(F.col("_above") * step, 9).alias("area")]
    g = inside.groupBy(*keys, "rep_no", "start_time", "end_time").agg(*sums)
    return g.select(*keys, "rep_no", "start_time", "end_time", F.round(span, 9).alias("duration"), "peak_time", *[F.round(c, 6).alias(k) for k, c in out.items()], *evidence, "n_samples")


def reject_opening_transient(evidence: DataFrame, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Repetitions without a first one that is far shorter, smaller and lower than the others; numbers run from 1 again."""
    by, weak = Window.partitionBy(*keys), F.lit(True)
    for c, share in TRANSIENT.items():
        usual = F.median(F.when(F.col("rep_no") > 1, F.col(c))).over(by)
        weak = weak & (usual > 0) & (F.col(c) < usual * share)
    kept = evidence.withColumn("_weak", F.coalesce(weak, F.lit(False))).filter((F.col("rep_no") > 1) | ~F.col("_weak")).drop("_weak")
    return kept.withColumn("rep_no", F.row_number().over(by.orderBy("rep_no")).cast("long"))


def measured_reps(smoothed: DataFrame, limits: DataFrame | None = None, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """The whole threshold detector, and what is measured in each repetition (:func:`measure`)."""
    rows = with_limits(smoothed, limits, keys)
    return reject_opening_transient(measure(rows, threshold_reps(rows, None, keys), keys), keys)


def detect(smoothed: DataFrame, limits: DataFrame | None = None, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """The whole threshold detector: fold, then rejection of an opening transient."""
    return measured_reps(smoothed, limits, keys).select(*keys, "rep_no", "start_time", "end_time")


def held_reps(rows: DataFrame, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """``rows`` (with thresholds) inside the repetitions of :func:`detect`, with ``rep_no, start_time, end_time``, in one sweep.

    Evidence against an opening transient comes from windows over the rows held,
    so that they are neither found a second time nor joined.
    """
    held = held_points(rows, threshold_reps(rows, None, keys), keys)
    by, inside = Window.partitionBy(*keys), Window.partitionBy(*keys, "rep_no")
    span, n, over = F.col("end_time") - F.col("start_time"), F.count(F.lit(1)).over(inside), F.col("smooth") - F.col("start_threshold")
    step = F.when(n > 1, span / (n - 1)).otherwise(0.0)
    marked = held.withColumns({
        "_first": F.row_number().over(inside.orderBy("seq")) == 1, "_duration": F.round(span, 9), "_peak_excess": F.round(F.max(over).over(inside), 9), "_area": F.round(F.sum(F.greatest(F.lit(0.0), over)).over(inside) * step, 9)})
    weak = F.col("rep_no") == 1
    for c, share in TRANSIENT.items():
        usual = F.median(F.when(F.col("_first") & (F.col("rep_no") > 1), F.col(f"_{c}"))).over(by)
        weak = weak & (usual > 0) & (F.col(f"_{c}") < usual * share)
    marked = marked.withColumn("_weak", F.coalesce(weak, F.lit(False))).withColumn("_gone", F.max(F.col("_weak").cast("long")).over(by))
    return marked.filter("not _weak").withColumn("rep_no", F.col("rep_no") - F.col("_gone")).drop("_first", "_duration", "_peak_excess", "_area", "_weak", "_gone")


def shown(measured: DataFrame) -> DataFrame:
    """The columns of :func:`measure` that callers see, to six decimals."""
    return measured.select("recording_id", "rep_no", *[F.round(c, 6).alias(c) for c in ("start_time", "end_time", "duration", "mean_value", "peak_value", "peak_time", "integral", "mean_activation")], "n_samples")


def rep_metrics(samples: DataFrame, reps: DataFrame) -> DataFrame:
    """Per repetition: duration, mean and peak of the raw samples, the first time of the peak, the trapezoid integral and its mean over time."""
    return shown(measure(samples.drop("smooth", "activation"), reps))


def set_summary(metrics: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row per recording: count, length of the set, means, strongest repetition, fall of the peak from the first half to the second.

    The first half has ``n div 2`` repetitions.  A recording without repetitions has zeros.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("recording_id"))
    halves = metrics.withColumn("_half", F.when(F.col("rep_no") <= F.floor(n / 2), 1).otherwise(2))
    g = halves.groupBy("recording_id").agg(
        F.count(F.lit(1)).cast("long").alias("rep_count"), (F.max_by("end_time", "rep_no") - F.min_by("start_time", "rep_no")).alias("set_duration"),
        steady_mean("duration").alias("avg_duration"), steady_mean("mean_value").alias("avg_value"), steady_mean("peak_value").alias("avg_peak"), F.max("peak_value").alias("highest_peak"),
        F.min_by("rep_no", F.struct(-F.col("peak_value"), F.col("rep_no"))).alias("strongest_rep"),
        steady_mean(F.when(F.col("_half") == 1, F.col("peak_value"))).alias("_first"), steady_mean(F.when(F.col("_half") == 2, F.col("peak_value"))).alias("_second"))
    drop = F.when(F.col("_first") > 0, (F.col("_first") - F.col("_second")) / F.col("_first") * 100).otherwise(0.0)
    full = recordings.select("recording_id").distinct().join(g.withColumn("peak_drop", F.coalesce(drop, F.lit(0.0))), "recording_id", "left")
    zero = ("set_duration", "avg_duration", "avg_value", "avg_peak", "highest_peak", "peak_drop")
    return full.select("recording_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rep_count", "strongest_rep")], *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in zero], (F.coalesce("peak_drop", F.lit(0.0)) >= 15).alias("possible_fatigue"))
