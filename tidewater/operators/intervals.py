"""Points in time and the intervals that hold them, in one sweep over both.

Points and the starts of intervals are put in one order of time.  A point then
needs only the interval that started last and, for points on a shared end, the one
before it, so the work is that of a sort, however many intervals a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _swept(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...], half_open: bool) -> tuple[DataFrame, list[str]]:
    """``points`` with ``_held``, the intervals that hold each in order of time, and the names of the intervals' columns."""
    own = [c for c in intervals.columns if c not in keys]
    kept = [c for c in points.columns if c not in own]
    whole = F.struct(*own)
    before = F.lag(whole).over(Window.partitionBy(*keys).orderBy("start_time", "end_time"))
    starts = intervals.select(*keys, F.col("start_time").alias("_t"), F.lit(0).alias("_kind"), F.struct(before.alias("before"), whole.alias("own")).alias("_interval"))
    rows = points.select(*keys, F.col("time_s").alias("_t"), F.lit(1).alias("_kind"), F.struct(*kept).alias("_point"))
    latest = F.last("_interval", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    # dealt anew: a union takes over the partitions of its parts, which adaptive execution may have joined up in different ways
    dealt = rows.unionByName(starts, allowMissingColumns=True).repartition(*keys)
    both = dealt.withColumn("_latest", latest).filter("_kind = 1")

    def if_held(side: str) -> Column:
        end = F.col(f"_latest.{side}.end_time")
        return F.when(end > F.col("_t") if half_open else end >= F.col("_t"), F.col(f"_latest.{side}"))

    return both.select("_point.*", F.array_compact(F.array(if_held("before"), if_held("own"))).alias("_held")), own


def held_points(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = ("recording_id",), half_open: bool = False) -> DataFrame:
    """A row for each point (``time_s``) and interval (``start_time, end_time``) of one key that holds it, with the columns of both.

    Intervals of one key may share end points but nothing else, as repetitions
    do; such a point belongs to both, or with ``half_open`` to the later one.
    Columns of points that are named like one of an interval are replaced.
    """
    swept, own = _swept(points, intervals, keys, half_open)
    return swept.select("*", F.explode("_held").alias("_one")).select(*[c for c in swept.columns if c != "_held"], *[F.col(f"_one.{c}").alias(c) for c in own])


def held_counts(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Every point with ``n_held``, how many intervals hold it: none, one, or two on a shared end."""
    swept, _ = _swept(points, intervals, keys, False)
    return swept.withColumn("n_held", F.size("_held")).drop("_held")


def first_interval(points: DataFrame, intervals: DataFrame, number: str, keys: tuple[str, ...] = ("recording_id",), half_open: bool = False, whole: DataFrame | None = None) -> DataFrame:
    """Every point with the columns of the interval that holds it, the one of the least ``number`` if two do; null where none does.

    ``whole`` (the keys, ``start_time, end_time``) tells the bounds that points
    outside all intervals get instead: those of their whole recording.
    """
    swept, own = _swept(points, intervals, keys, half_open)
    least = F.array_min(F.transform("_held", lambda x: F.struct(x[number].alias("_number"), x.alias("of"))))["of"]
    found = swept.withColumn("_one", least).select(*[c for c in swept.columns if c != "_held"], *[F.col(f"_one.{c}").alias(c) for c in own])
    if whole is None:
        return found
    bounds = whole.select(*keys, F.col("start_time").alias("_start"), F.col("end_time").alias("_end"))
    return found.join(bounds, list(keys), "left").withColumns({"start_time": F.coalesce("start_time", "_start"), "end_time": F.coalesce("end_time", "_end")}).drop("_start", "_end")


def extent(samples: DataFrame, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """The first and last time of each recording."""
    return samples.groupBy(*keys).agg(F.min("time_s").alias("start_time"), F.max("time_s").alias("end_time"))


def active_cue(points: DataFrame, cues: DataFrame) -> DataFrame:
    """Times ``session_id, time_s`` with the ``rep`` and ``phase`` of the cue that is on then: from its start to just before its end."""
    spans = cues.select("session_id", "rep", "phase", "start_time", "end_time").withColumn("_cue", F.struct("start_time", "end_time"))
    return first_interval(points, spans, "_cue", ("session_id",), half_open=True).drop("start_time", "end_time", "_cue")
