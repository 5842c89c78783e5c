"""Statistics over repetitions, sets and raw recordings."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Fixed: levels over the baseline of a recording without calibration.
WARMUP, ENTER_FLOOR, LEAVE_FLOOR, ENTER_SHARE, LEAVE_SHARE = 30, 18.0, 12.0, 0.12, 0.075


def rounded(**columns: Column) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def _set_values(prefix: str) -> list[tuple[str, Column]]:
    """Of a set's repetitions: the median of their time-weighted means, the means of the early and the late ones, their change and trend."""
    value = f"{prefix}mean_activation"
    mean = lambda c: F.round(F.sum(c), 6) / F.count(c)
    early, late = mean(F.when(F.col("_early"), F.col(value))), mean(F.when(~F.col("_early"), F.col(value)))
    return [(f"{prefix}median_activation", F.median(value)), (f"{prefix}early_mean", early), (f"{prefix}late_mean", late), (f"{prefix}change", late - early), (f"{prefix}slope", _slope("rep_no", value)), (f"{prefix}peak_activation", F.max(f"{prefix}peak_value")), (f"_{prefix}integral", F.round(F.sum(f"{prefix}integral"), 6))]


def set_metrics(measured: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row for every recording of ``recordings``: extremes and length of the recording, and what its repetitions add up to.

    ``measured`` comes from :func:`~tidewater.operators.detect.measured_reps`;
    ``recordings`` has ``recording_id, raw_min, raw_max, recording_duration`` and
    ``calibration_usable``.  A repetition's mean is its integral over its
    duration.  The early part has ``max(1, n div 2)`` repetitions.  Spread and its
    share of the mean are those of durations, 0 for fewer than two.  A set without
    repetitions has the recording's length, zeros, and nothing to tell of early,
    late and trend.  Columns from ``norm_`` on are null without a usable calibration.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("recording_id"))
    split = measured.withColumn("_early", F.col("rep_no") <= F.greatest(F.lit(1), F.floor(n / 2)))
    norm = "norm_mean_activation" in measured.columns
    active, mean_duration = F.round(F.sum("duration"), 6), F.round(F.sum("duration"), 6) / F.count(F.lit(1))
    deviation = F.coalesce(F.stddev_pop("duration"), F.lit(0.0))
    g = split.groupBy("recording_id").agg(
        F.count(F.lit(1)).cast("long").alias("rep_count"), active.alias("active_time"), (F.max_by("end_time", "rep_no") - F.min_by("start_time", "rep_no")).alias("set_duration"), mean_duration.alias("mean_duration"), F.median("duration").alias("median_duration"),
        deviation.alias("duration_deviation"), F.when(mean_duration == 0, 0.0).otherwise(deviation / mean_duration * 100).alias("duration_variation"), *[c.alias(k) for prefix in ("", *(["norm_"] if norm else [])) for k, c in _set_values(prefix)])
    j = recordings.join(g, "recording_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    per_second = lambda c: F.try_divide(F.col(c), F.nullif(F.col("active_time"), F.lit(0.0)))
    plain = {k: zero(k) for k in ("active_time", "mean_duration", "median_duration", "duration_deviation", "duration_variation", "median_activation", "peak_activation")}
    plain |= {"set_duration": F.coalesce("set_duration", "recording_duration"), "total_integral": zero("_integral"), "mean_activation": F.coalesce(per_second("_integral"), F.lit(0.0)), **{k: F.col(k) for k in ("early_mean", "late_mean", "change", "slope")}}
    if norm:
        usable = lambda c: F.when(F.col("calibration_usable"), c)
        plain |= {f"norm_{k}": usable(c) for k, c in (
            ("mean_activation", per_second("_norm_integral")), ("median_activation", zero("norm_median_activation")), ("integral", zero("_norm_integral")), *[(k, F.col(f"norm_{k}")) for k in ("peak_activation", "early_mean", "late_mean", "change", "slope")])}
    return j.select("recording_id", F.coalesce("rep_count", F.lit(0).cast("long")).alias("rep_count"), "raw_min", "raw_max", "recording_duration", "calibration_usable", *[F.round(c, 6).alias(k) for k, c in plain.items()])


def _slope(x: str, y: str) -> Column:
    """The slope of the regression line, from sums that are rounded first, so that the order of rows does not show; null for fewer than two places."""
    n, sx, sxx = F.count(F.lit(1)), F.sum(x), F.sum(F.col(x) * F.col(x))
    sy, sxy = F.round(F.sum(y), 6), F.round(F.sum(F.col(x) * F.col(y)), 6)
    return F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)


def raw_statistics(samples: DataFrame) -> DataFrame:
    """Count, extremes, mean, rate, largest and mean gap, share at the maximum, share above the middle of the range, and warnings."""
    w, by = Window.partitionBy("recording_id").orderBy("seq"), Window.partitionBy("recording_id")
    rows = samples.withColumns({"_gap": (F.col("time_s") - F.lag("time_s").over(w)) * 1000, "_lo": F.min("raw").over(by), "_hi": F.max("raw").over(by)})
    g = rows.groupBy("recording_id").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.min("raw").alias("lowest"), F.max("raw").alias("highest"),
        *rounded(
            mean=F.avg("raw"), rate=F.try_divide(F.count(F.lit(1)), F.max("time_s") - F.min("time_s")), largest_gap_ms=F.max("_gap"), mean_gap_ms=F.avg("_gap"),
            pinned=F.avg(((F.col("raw") == F.col("_hi")) | (F.col("raw") == F.col("_lo"))).cast("int")), percent_above_middle=F.avg((F.col("raw") > (F.col("_lo") + F.col("_hi")) / 2).cast("int")) * 100,
        ),
    )
    span = F.col("highest") - F.col("lowest")
    warn = F.array_compact(F.array(
        F.when(F.col("n") < 20, "few samples"), F.when(span <= 2, "flat signal").when(span < 20, "small range"), F.when(F.col("pinned") >= 0.25, "pinned signal"),
        F.when((F.col("largest_gap_ms") > 1000) | (F.col("mean_gap_ms") > 100.000001), "gaps in time")))
    return g.withColumn("warnings", F.array_join(warn, "; "))


class LowTail:
    """Levels of a recording from its readings so far: how often each value came, the sum of the lowest tenth, the greatest.

    Memory is that of the different values, a thousand or so for a sensor's
    converter, not of the readings; a reading costs a search among them.
    ``edge`` is the highest value of the lowest tenth, ``taken`` how many of it
    belong there.
    """

    def __init__(self, counts: dict[float, int] | None = None, warmup: int = WARMUP):
        self.counts, self.warmup = dict(counts or {}), warmup
        self.values = sorted(self.counts)
        self.n = sum(self.counts.values())
        self.total = math.fsum(v * c for v, c in self.counts.items())
        self.k, self.edge, self.taken, self.low_sum = max(1, self.n // 10), -math.inf, 0, 0.0
        left = self.k
        for v in self.values:
            self.edge, self.taken = v, min(left, self.counts[v])
            self.low_sum += v * self.taken
            left -= self.taken
            if not left:
                break

    def add(self, value: float) -> None:
        if value in self.counts:
            self.counts[value] += 1
        else:
            insort(self.values, value)
            self.counts[value] = 1
        self.n, self.total = self.n + 1, self.total + value
        if self.n == 1:
            self.edge, self.taken, self.low_sum = value, 1, value
            return
        if value < self.edge:  # one of the edge's gives way
            self.low_sum += value - self.edge
            self.taken -= 1
            if not self.taken:
                self.edge = self.values[bisect_left(self.values, self.edge) - 1]
                self.taken = self.counts[self.edge]
        if max(1, self.n // 10) > self.k:
            self.k += 1
            if self.taken < self.counts[self.edge]:
                self.taken += 1
            else:
                self.edge, self.taken = self.values[bisect_left(self.values, self.edge) + 1], 1
            self.low_sum += self.edge

    def levels(self) -> tuple[float, float] | None:
        """Enter and leave level; none before the first reading."""
        if not self.n:
            return None
        if self.n < self.warmup:
            mean = self.total / self.n
            return mean + ENTER_FLOOR, mean + LEAVE_FLOOR
        base = self.low_sum / self.k
        span = self.values[-1] - base
        return base + max(ENTER_FLOOR, ENTER_SHARE * span), base + max(LEAVE_FLOOR, LEAVE_SHARE * span)


def expanding_baseline(samples: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """Enter and leave levels at every row from the rows so far.

    Before ``warmup`` rows the running mean plus 18 and 12; then the mean of the
    lowest ``max(1, n div 10)`` values, plus a share of the greatest value's
    distance from it, 18 and 12 at least.  A row without a value keeps the
    levels before it and counts for nothing; before the first value they are null.
    """
    kept = samples.drop("enter", "leave")
    key, value = kept.columns.index("recording_id"), kept.columns.index("raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tail = object(), LowTail(warmup=warmup)
        for b in batches:
            made: list[tuple[float | None, float | None]] = []
            for k, v in zip(b.column(key).to_pylist(), b.column(value).to_pylist()):
                if k != at:
                    at, tail = k, LowTail(warmup=warmup)
                if v is not None and v == v:
                    tail.add(float(v))
                made.append(tail.levels() or (None, None))
            columns = [pa.array([None if m[i] is None else round(m[i], 7) for m in made], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "enter", "leave"])

    return kept.repartition("recording_id").sortWithinPartitions("recording_id", "seq").mapInArrow(run, StructType(kept.schema.fields + [StructField("enter", DoubleType()), StructField("leave", DoubleType())]))


def group_sets(summaries: DataFrame) -> DataFrame:
    """Sets by exercise, weight and side; those that lack one are listed under the names of what is missing."""
    names = ("exercise", "weight", "side")
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    missing = F.array_join(F.array_compact(F.array(*[F.when(empty(c), c) for c in names])), ",")
    return summaries.withColumn("missing", missing).groupBy(*names, "missing").agg(F.count(F.lit(1)).cast("long").alias("sets"), F.min("recording_id").alias("first_recording"))


def difference(a: Column, b: Column) -> Column:
    """Percent by which two values differ, over the smaller magnitude; 0 where that is next to nothing, null if either is."""
    low = F.least(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), None).when(low <= 1e-9, 0.0).otherwise(F.abs(a - b) / low * 100)


def difference_over_lower(a: Column, b: Column) -> Column:
    """Percent over the lower of two values, sign and all; 0 where that is 0."""
    low = F.least(a, b)
    return F.when(low == 0, 0.0).otherwise((F.greatest(a, b) - low) / low * 100)


def winner(a: Column, b: Column, first: str = "Set 1", second: str = "Set 2", tie: str = "Tie") -> Column:
    return F.when(a > b, first).when(b > a, second).otherwise(tie)


def class_balance(rows: DataFrame, truth: Column, group: str) -> DataFrame:
    """Rows and share of the positive class, over all and how many groups there are."""
    return rows.agg(
        F.count_if(truth).cast("long").alias("positive"), F.count_if(~truth).cast("long").alias("negative"), F.round(F.avg(truth.cast("int")), 6).alias("fraction"), F.count_distinct(group).cast("long").alias("groups"))


def side_averages(sets: DataFrame, value: str) -> DataFrame:
    """Mean of each side, the percent by which its two sets differ (null unless there are exactly two), per participant."""
    g = sets.groupBy("participant_id", "side").agg(F.count(F.lit(1)).cast("long").alias("sets"), F.sum(value).alias("_sum"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spread = F.when(F.col("sets") == 2, difference(F.col("_lo"), F.col("_hi")))
    return g.select("participant_id", "side", "sets", F.round(F.round("_sum", 6) / F.col("sets"), 6).alias("average"), F.round(spread, 6).alias("repeat_difference"))


def ladder_extremes(levels: DataFrame, value: str) -> DataFrame:
    """Of each participant's levels of weight, those with the highest and the lowest value to one decimal; the first level wins ties, and one level alone gives none."""
    shown = levels.withColumn("_v", F.round(value, 1))
    g = shown.groupBy("participant_id").agg(F.count(F.lit(1)).alias("_n"), F.min_by("weight", F.struct(-F.col("_v"), F.col("weight"))).alias("highest_at"), F.min_by("weight", F.struct("_v", "weight")).alias("lowest_at"))
    return g.filter("_n >= 2").drop("_n")
