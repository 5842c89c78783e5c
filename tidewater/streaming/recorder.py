"""Recordings of a device's lines as they come in: clocks without rollovers, rows appended batch by batch, lines that can't be read counted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from ..sources.signals import CLOCK_PERIOD, Clock, parse_lines
from .lifecycle import IDLE_MS, _store, _Timed


class _Device(_Timed):
    """The clock of a recording's device and the host's time of its first reading that counted."""

    def __init__(self, period: int, idle_ms: int):
        self.period, self.idle_ms = period, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.clock = handle.getValueState("clock", "last long, turns long, first_host long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        last, turns, first = self.clock.get() if self.clock.exists() else (None, 0, None)
        clock, times, elapsed = Clock(self.period, last, turns), [], []
        for device, host, value in batch[["device_time_ms", "host_time_ms", "value"]].itertuples(index=False, name=None):
            counts = not pd.isna(value) and not pd.isna(host)
            if counts and first is None:
                first = int(host)
            times.append(clock.read(None if pd.isna(device) else int(device)))
            elapsed.append(int(host) - first if counts else None)
        self.clock.update((clock.last, clock.turns, first))
        self.wait(timerValues, self.idle_ms)
        whole = lambda xs: pd.array(xs, dtype="Int64")
        yield pd.DataFrame({"recording_id": key[0], "seq": batch["seq"].to_numpy(), "time_ms": whole(elapsed), "host_time_ms": batch["host_time_ms"].astype("Int64").array, "device_time_ms": whole(times), "value": batch["value"].to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clock.clear()
        yield from ()


def clocked(readings: DataFrame, period: int = CLOCK_PERIOD, idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of ``recording_id, seq, host_time_ms, device_time_ms, value`` with its device's times without rollovers, and ``time_ms`` of the host since its first reading with a value.

    Readings of one batch are put in the order of ``seq``; over batches they are
    taken as they come.  Times are those of
    :func:`~tidewater.sources.signals.unwrap_clock` over the same readings.  A
    recording whose readings stop for ``idle_ms`` is forgotten.
    """
    _store(readings.sparkSession)
    kind = readings.schema["recording_id"].dataType.simpleString()
    plain = readings.select("recording_id", F.col("seq").cast("long"), F.col("host_time_ms").cast("long"), F.col("device_time_ms").cast("long"), F.col("value").cast("double"))
    schema = f"recording_id {kind}, seq long, time_ms long, host_time_ms long, device_time_ms long, value double"
    return plain.groupBy("recording_id").transformWithStateInPandas(_Device(period, idle_ms), schema, "Append", "ProcessingTime")


def append_recordings(lines: DataFrame, path: str, checkpoint: str, phase: str | None = None, available_now: bool = True):
    """A stream of ``recording_id, seq, host_time_ms, line`` appended to ``path/rows``, and lines without a value counted in ``path/malformed``.

    Each batch has folders of its own, which a repeated batch overwrites, so every
    line is kept or counted once.  ``phase`` names the part of a calibration that
    is being recorded.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            good = batch.filter("value is not null").withColumn("phase", F.lit(phase).cast("string"))
            good.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            bad = batch.filter("value is null").groupBy("recording_id").agg(F.count(F.lit(1)).alias("malformed"))
            bad.write.mode("overwrite").parquet(f"{path}/malformed/batch={number}")
        finally:
            batch.unpersist()

    writer = clocked(parse_lines(lines)).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``recording_id, malformed`` over all batches of :func:`append_recordings`."""
    return spark.read.parquet(f"{path}/malformed").groupBy("recording_id").agg(F.sum("malformed").alias("malformed"))
