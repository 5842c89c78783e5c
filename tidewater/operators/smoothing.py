"""Moving averages and thresholds of recordings, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

WINDOW = 15
LOW_PERCENT = 10
START_FRACTION, END_FRACTION = 0.18, 0.085


def _order() -> WindowSpec:
    return Window.partitionBy("recording_id").orderBy("seq")


def _all() -> WindowSpec:
    return Window.partitionBy("recording_id")


def centered_average(signals: DataFrame, window: int = WINDOW) -> DataFrame:
    """``smooth``: the mean of ``min(window, n) // 2`` rows on either side, cut at the ends.

    A recording shorter than the window has a narrower frame.  Its few rows are
    gathered and averaged in order; of others none are, and they need one frame.
    """
    if window <= 1:
        return signals.withColumn("smooth", F.col("raw"))
    widest = window // 2
    short, half = F.col("_rows") < 2 * widest, F.floor(F.col("_rows") / 2).cast("int")
    ordered = _order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = signals.withColumn("_rows", F.count(F.lit(1)).over(_all()))
    rows = rows.withColumns({"_own": F.collect_list(F.when(short, F.struct("raw"))).over(ordered), "_at": F.row_number().over(_order()), "_mean": F.avg("raw").over(_order().rowsBetween(-widest, widest))})
    first = F.greatest(F.lit(1), F.col("_at") - half)
    near = F.filter(F.transform(F.slice("_own", first, F.col("_at") + half - first + 1), lambda x: x["raw"].cast("double")), lambda x: x.isNotNull())
    mean = F.aggregate(near, F.lit(0.0), lambda total, x: total + x) / F.nullif(F.size(near), F.lit(0))
    return rows.withColumn("smooth", F.round(F.when(short, mean).otherwise(F.col("_mean")), 9)).drop("_rows", "_own", "_at", "_mean")


def trailing_average(signals: DataFrame, window: int = WINDOW) -> DataFrame:
    return signals.withColumn("trailing", F.round(F.avg("raw").over(_order().rowsBetween(1 - window, 0)), 9))


def tail_means(signals: DataFrame, value: str = "smooth", percent: int = LOW_PERCENT, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Per recording: the mean of its lowest and of its highest ``max(1, n * percent / 100)`` values, ``n``, and the extremes."""
    by = Window.partitionBy(*keys)
    k = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(by) * percent / 100))
    up = F.row_number().over(by.orderBy(F.col(value)))  # equal values weigh alike, so one order serves both ends
    ranked = signals.select(*keys, value, "time_s", "seq", k.alias("_k"), up.alias("_up"), F.count(F.lit(1)).over(by).alias("_n"))
    mean = lambda near: F.avg(F.when(near, F.col(value)))
    return ranked.groupBy(*keys).agg(
        F.round(mean(F.col("_up") <= F.col("_k")), 9).alias("low_mean"), F.round(mean(F.col("_up") > F.col("_n") - F.col("_k")), 9).alias("high_mean"), F.count(F.lit(1)).cast("long").alias("n"),
        F.min(value).alias("lowest"), F.max(value).alias("highest"), F.max_by("time_s", "seq").alias("end_time"))


def thresholds(smoothed: DataFrame, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Baseline, range and the start and end thresholds of each recording."""
    t = tail_means(smoothed, keys=keys)
    span = F.col("highest") - F.col("low_mean")
    return t.select(
        *keys, F.col("low_mean").alias("baseline"), F.col("highest").alias("max_signal"), F.round(span, 9).alias("signal_range"),
        F.round(F.col("low_mean") + START_FRACTION * span, 9).alias("start_threshold"), F.round(F.col("low_mean") + END_FRACTION * span, 9).alias("end_threshold"),
        F.col("n").alias("reference_count"), F.col("end_time").alias("reference_end_time"))


def with_thresholds(smoothed: DataFrame, keys: tuple[str, ...] = ("recording_id",), ranges: bool = False) -> DataFrame:
    """``smoothed`` with its recordings' ``start_threshold`` and ``end_threshold``, and ``signal_range`` if asked for: :func:`thresholds` beside every row, without a join."""
    by = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(by)
    ranked = smoothed.withColumns({"_up": F.row_number().over(by.orderBy("smooth")), "_k": F.greatest(F.lit(1), F.floor(n * LOW_PERCENT / 100)), "_high": F.max("smooth").over(by)})
    low = F.round(F.avg(F.when(F.col("_up") <= F.col("_k"), F.col("smooth"))).over(by), 9)
    rows = ranked.withColumn("_low", low)
    limit = lambda share: F.round(F.col("_low") + share * (F.col("_high") - F.col("_low")), 9)
    own = {"signal_range": F.round(F.col("_high") - F.col("_low"), 9)} if ranges else {}
    return rows.withColumns({"start_threshold": limit(START_FRACTION), "end_threshold": limit(END_FRACTION), **own}).drop("_up", "_k", "_high", "_low")


def with_prefix_thresholds(smoothed: DataFrame) -> DataFrame:
    """Rows of the recordings whose :func:`active_prefix` is shorter than they are, with the thresholds of that prefix, without a join."""
    rows = with_thresholds(smoothed, ranges=True)
    rows = rows.withColumn("_last", F.max(F.when((F.col("signal_range") > 0) & (F.col("smooth") > F.col("end_threshold")), F.col("seq"))).over(_all())).drop("signal_range")
    rows = rows.withColumn("_in", F.col("seq") <= F.col("_last")).withColumn("_shorter", F.max((~F.col("_in")).cast("int")).over(_all()) == 1)
    part = with_thresholds(rows.filter("_shorter"), ("recording_id", "_in"))
    limit = lambda c: F.max(F.when(F.col("_in"), F.col(c))).over(_all())
    return part.withColumns({c: limit(c) for c in ("start_threshold", "end_threshold")}).drop("_last", "_in", "_shorter")


def active_prefix(smoothed: DataFrame) -> DataFrame:
    """Rows up to the last one above the end threshold of the whole recording; all rows if none is above it or the signal is flat."""
    joined = smoothed.join(thresholds(smoothed).select("recording_id", F.col("end_threshold").alias("_end"), F.col("signal_range").alias("_range")), "recording_id")
    last = F.max(F.when((F.col("_range") > 0) & (F.col("smooth") > F.col("_end")), F.col("seq"))).over(_all())
    return joined.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("seq") <= F.col("_last"))).drop("_last", "_end", "_range")


def crossings(smoothed: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows where the smooth signal rises over the start threshold, with the thresholds of ``limits``."""
    before = F.lag("smooth").over(_order())
    rows = smoothed.withColumn("_before", before).join(limits.select("recording_id", "start_threshold"), "recording_id")
    return rows.filter((F.col("_before") <= F.col("start_threshold")) & (F.col("smooth") > F.col("start_threshold"))).drop("_before")


def local_minima(smoothed: DataFrame) -> DataFrame:
    """Interior rows not above the one before and below the one after: the last row of each valley's floor."""
    rows = smoothed.withColumns({"_before": F.lag("smooth").over(_order()), "_after": F.lead("smooth").over(_order())})
    return rows.filter((F.col("smooth") <= F.col("_before")) & (F.col("smooth") < F.col("_after"))).drop("_before", "_after")


def valley_clusters(minima: DataFrame, gap_s: float = 0.30) -> DataFrame:
    """Minima at most ``gap_s`` apart are one valley, named by its lowest, earliest minimum."""
    fresh = F.when(F.round(F.col("time_s") - F.lag("time_s").over(_order()), 6) <= gap_s, 0).otherwise(1)
    marked = minima.withColumn("_new", fresh).withColumn("cluster", F.sum("_new").over(_order().rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return marked.groupBy("recording_id", "cluster").agg(F.min_by("seq", F.struct("smooth", "seq")).alias("seq"), F.min("smooth").alias("smooth"), F.count(F.lit(1)).cast("long").alias("members"))


def longest_run(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per key the longest time between the first and last of consecutive ``seq`` rows."""
    island = F.col("seq") - F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    runs = rows.withColumn("_island", island).groupBy(*keys, "_island").agg((F.max("time_s") - F.min("time_s")).alias("_span"))
    return runs.groupBy(*keys).agg(F.max("_span").alias("longest_run"))


def hysteresis(signals: DataFrame, enter: Column, leave: Column, value: str = "raw") -> DataFrame:
    """``active``: on from the first row at or above ``enter`` until one at or below ``leave``."""
    said = F.when(F.col(value) >= enter, F.lit(1)).when(F.col(value) <= leave, F.lit(0))
    return signals.withColumn("active", F.coalesce(F.last(said, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1)


def recent_window(signals: DataFrame, seconds: float = 8.0, most: int = 2000) -> DataFrame:
    """The rows of each recording's last ``seconds``, at most ``most`` of them: what a live plot shows."""
    end = F.max("time_s").over(_all())
    back = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("seq")))
    marked = signals.withColumns({"_end": end, "_back": back})
    return marked.filter((F.round(F.col("_end") - F.col("time_s"), 6) <= seconds) & (F.col("_back") <= most)).drop("_end", "_back")


def activity(active: DataFrame, substantial_s: float = 0.5, apart_s: float = 0.75) -> DataFrame:
    """Per recording: active time and episodes of a signal marked ``active`` (see :func:`hysteresis`).

    Active time adds the step to each active row. An episode lasts from its first
    active row to the first inactive row after it, or the last row; it counts if
    it is substantial and begins ``apart_s`` after the last substantial one ended.
    """
    w = _order()
    step = F.col("time_s") - F.lag("time_s").over(w)
    edge = F.when(F.col("active") & ~F.coalesce(F.lag("active").over(w), F.lit(False)), 1).otherwise(0)
    rows = active.withColumns({"_step": F.when(F.col("active"), F.coalesce(step, F.lit(0.0))).otherwise(0.0), "_edge": edge, "_next": F.coalesce(F.lead("time_s").over(w), F.col("time_s"))})
    rows = rows.withColumn("_episode", F.sum("_edge").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.filter("active").groupBy("recording_id", "_episode").agg(F.min("time_s").alias("s"), F.max("_next").alias("e")).filter(F.round(F.col("e") - F.col("s"), 6) >= substantial_s)
    before = F.lag("e").over(Window.partitionBy("recording_id").orderBy("_episode"))
    counted = spans.withColumn("_b", before).filter(F.col("_b").isNull() | (F.round(F.col("s") - F.col("_b"), 6) >= apart_s)).groupBy("recording_id").agg(F.count(F.lit(1)).cast("long").alias("episodes"))
    total = rows.groupBy("recording_id").agg(F.round(F.sum("_step"), 6).alias("active_time"))
    return total.join(counted, "recording_id", "left").withColumn("episodes", F.coalesce("episodes", F.lit(0).cast("long")))
