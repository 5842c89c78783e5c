"""Time stamps of live samples: the device's clock where there is one, its drift from the host's, and its gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: drift that is warned of, and a gap of the device's clock that is noted.
DRIFT_MS, GAP_MS = 1000, 5000


def sample_timing(readings: DataFrame) -> DataFrame:
    """Readings ``recording_id, seq, host_ms, device_ms`` (null if unknown) with their times.

    ``host_elapsed_ms`` runs from the first reading.  ``time_ms`` is the device's
    time since its first one, never below 0, or else the host's.  ``drift_ms`` is
    what the host's is ahead, ``drift_warning`` tells whether a drift so far has
    reached ``DRIFT_MS``, and ``gap_ms`` is the device's step where it is more
    than ``GAP_MS``.  All windows share one order of a recording.
    """
    w = Window.partitionBy("recording_id").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    host = F.col("host_ms") - F.first("host_ms").over(so_far)
    first = F.first("device_ms", ignorenulls=True).over(so_far)
    before = F.last("device_ms", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    device = F.greatest(F.lit(0), F.col("device_ms") - first)
    device = F.when(F.col("device_ms").isNotNull(), device)
    t = readings.withColumns({"host_elapsed_ms": host, "_device": device, "_step": F.col("device_ms") - before})
    t = t.withColumns({"time_ms": F.coalesce("_device", "host_elapsed_ms"), "drift_ms": F.col("host_elapsed_ms") - F.col("_device"), "gap_ms": F.when(F.col("_step") > GAP_MS, F.col("_step"))})
    warned = F.coalesce(F.max(F.abs("drift_ms") >= DRIFT_MS).over(so_far), F.lit(False))
    return t.withColumn("drift_warning", warned).drop("_device", "_step")


def relative_time(samples: DataFrame) -> DataFrame:
    """``time_s`` from the first sample of each recording on, in the order of its rows."""
    w = Window.partitionBy("recording_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return samples.withColumn("time_s", F.col("time_s") - F.first("time_s").over(w))
