"""When has a live set ended?  One state machine per recording, on streams and on stored readings.

A set is armed once enough has happened: ten seconds have passed, there was
meaningful activity at least six seconds ago, and either three episodes or eight
active seconds.  From then on six seconds of inactivity end it.  Readings are
smoothed over the last 15.  A recording with a usable calibration has fixed
levels; any other has levels over the lowest tenth of its readings so far, which
change with every reading.  A stream keeps the machine in Spark's state store
(:func:`watch`) and a table replays it per recording (:func:`replay`); both run
the same code.  The state is a handful of numbers, the last 15 readings and, for a
recording without calibration, how often each value has come: a map in the store of
which a batch reads and writes entries.  A timer takes every set out of the store in
the end, also one whose readings just stop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import live
from ..operators.metrics import ENTER_FLOOR, ENTER_SHARE, LEAVE_FLOOR, LEAVE_SHARE, LowTail

#: Fixed: the rules of arming and ending.
ARM_AFTER_S, MEANINGFUL_S, MEANINGFUL_AGO_S, EPISODES, ACTIVE_S = 10.0, 0.75, 6.0, 3, 8.0
GRACE_S, FINISH_S = 1.25, 6.0
EPISODE_S, EPISODE_GAP_S = 0.5, 0.75
SMOOTHING = 15
#: How long a stream waits for a set's next reading, and how long it remembers that one has finished.
IDLE_MS, FORGET_MS = 900_000, 3_600_000
#: A first reading so much older than the next, while both came together, belongs to an earlier run.
STALE_DEVICE_MS, STALE_HOST_MS = 5000, 1000

TRANSITIONS = {
    "idle": {"countdown", "recording", "cancelled"}, "countdown": {"recording", "cancelled"}, "recording": {"possible_end", "finished", "cancelled", "failed"},
    "possible_end": {"recording", "finished", "cancelled", "failed"}, "finished": {"analyzing", "failed"}, "analyzing": {"results", "failed"}, "results": {"idle"}, "cancelled": {"idle"}, "failed": {"idle"},
}


def transition(state: str, to: str) -> str:
    if to not in TRANSITIONS.get(state, ()):
        raise ValueError(f"no way from {state} to {to}")
    return to


@dataclass
class SetState:
    """What is remembered of a recording between readings; times in seconds, -1 where unset."""

    enter: float = ENTER_FLOOR
    leave: float = LEAVE_FLOOR
    calibrated: bool = False
    first: float = -1.0
    last: float = -1.0
    active: bool = False
    active_time: float = 0.0
    episode_start: float = -1.0
    episode_end: float = -1.0
    episodes: int = 0
    last_active: float = -1.0
    meaningful_at: float = -1.0
    idle_since: float = -1.0
    armed: bool = False
    finished_at: float = -1.0
    given_up: bool = False
    readings: int = 0
    recent: list[float] = field(default_factory=list)
    counts: dict[float, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._tail = LowTail(self.counts)
        self.counts = self._tail.counts

    def _smoothed(self, value: float) -> float:
        """The mean of the last readings; without calibration the levels move with this one."""
        self.recent = [*self.recent, float(value)][-SMOOTHING:]
        if not self.calibrated:
            self._tail.add(float(value))
            self.enter, self.leave = self._tail.levels()
        return sum(self.recent) / len(self.recent)

    def observe(self, t: float, value: float) -> None:
        """One more reading; one without a value is none."""
        if self.finished_at >= 0 or value != value:
            return
        self.readings += 1
        value = self._smoothed(value)
        if self.first < 0:
            self.first = t
        was, self.active = self.active, value >= self.enter if not self.active else value > self.leave
        step = max(0.0, t - self.last) if self.last >= 0 else 0.0
        if self.active:
            self.active_time += step
            self.last_active, self.idle_since = t, -1.0
            if not was:
                self.episode_start = t
        else:
            if was:
                self._close(t)
            if self.armed and self.last_active >= 0 and t - self.last_active >= GRACE_S:
                if self.idle_since < 0:
                    self.idle_since = t
                elif t - self.idle_since >= FINISH_S:
                    self.finished_at = t
                    self.recent.clear()
                    self.counts.clear()
            else:
                self.idle_since = -1.0
        if self.meaningful_at < 0 and self.active_time >= MEANINGFUL_S:
            self.meaningful_at = t
        self.last = t
        # arming comes last: the branch above sees what was armed before this reading
        open_one = int(self.active and t - self.episode_start >= EPISODE_S and self._apart(self.episode_start))
        enough = self.episodes + open_one >= EPISODES or self.active_time >= ACTIVE_S
        self.armed = self.armed or t - self.first >= ARM_AFTER_S and self.meaningful_at >= 0 and t - self.meaningful_at >= MEANINGFUL_AGO_S and enough

    def _apart(self, start: float) -> bool:
        return self.episode_end < 0 or start - self.episode_end >= EPISODE_GAP_S

    def _close(self, t: float) -> None:
        if t - self.episode_start >= EPISODE_S:
            self.episodes += self._apart(self.episode_start)
            self.episode_end = t
        self.episode_start = -1.0

    def abandon(self) -> None:
        """No reading will come any more: an armed set has ended with its last one, any other is given up."""
        if self.finished_at < 0:
            self.given_up = not self.armed
            self.finished_at = self.last

    @property
    def status(self) -> str:
        if self.given_up:
            return "cancelled"
        return "finished" if self.finished_at >= 0 else "possible_end" if self.idle_since >= 0 else "recording"


def levels(baseline: float, signal_range: float) -> dict[str, float | bool]:
    """The levels of a calibrated recording."""
    return {"enter": baseline + ENTER_SHARE * signal_range, "leave": baseline + LEAVE_SHARE * signal_range, "calibrated": True}


def with_calibration(readings: DataFrame, calibrations: DataFrame) -> DataFrame:
    """``readings`` with the ``baseline`` and ``signal_range`` of their recording; null where there is none, or none that is usable.

    ``calibrations`` has one row a recording: ``recording_id, baseline,
    signal_range`` and, if it is known, ``usable``.
    """
    c = calibrations.filter("usable") if "usable" in calibrations.columns else calibrations
    return readings.drop("baseline", "signal_range").join(c.select("recording_id", "baseline", "signal_range"), "recording_id", "left")


def _calibrated(readings: DataFrame, baseline: float | None, signal_range: float | None) -> DataFrame:
    """Readings with the calibration of the call, or else that of their own columns, or none."""
    own = {"baseline", "signal_range"} <= set(readings.columns)
    if baseline is not None and signal_range is not None:
        b, r = F.lit(float(baseline)), F.lit(float(signal_range))
    else:
        b, r = (F.col("baseline"), F.col("signal_range")) if own else (F.lit(None), F.lit(None))
    return readings.select("recording_id", F.col("time_s").cast("double"), F.col("value").cast("double"), b.cast("double").alias("baseline"), r.cast("double").alias("signal_range"))


def _start(rows: pd.DataFrame) -> SetState:
    """The state before the first reading, with the levels of the calibration that comes with it."""
    b, r = rows["baseline"].iloc[0], rows["signal_range"].iloc[0]
    return SetState() if pd.isna(b) or pd.isna(r) else SetState(**levels(float(b), float(r)))


_RESULT = "recording_id {id}, status string, readings long, episodes long, active_time double, armed boolean, finished_at double"


def _row(key, state: SetState) -> pd.DataFrame:
    return pd.DataFrame({
        "recording_id": [key], "status": [state.status], "readings": [state.readings], "episodes": [state.episodes], "active_time": [round(state.active_time, 6)], "armed": [bool(state.armed)],
        "finished_at": pd.Series([state.finished_at if state.finished_at >= 0 else None], dtype="float64")})


def replay(readings: DataFrame, baseline: float | None = None, signal_range: float | None = None) -> DataFrame:
    """The last state of each stored recording ``recording_id, time_s, value``.

    Columns ``baseline`` and ``signal_range`` (:func:`with_calibration`) are a
    recording's calibration, null for none; ``baseline`` and ``signal_range`` of
    the call are that of all recordings.
    """
    kind = readings.schema["recording_id"].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("time_s")
        state = _start(rows)
        for t, v in rows[["time_s", "value"]].itertuples(index=False, name=None):
            state.observe(t, v)
        return _row(key[0], state)

    return _calibrated(readings, baseline, signal_range).groupBy("recording_id").applyInPandas(run, _RESULT.format(id=kind))


def _store(spark: SparkSession) -> None:
    """Processors with several states need a store that has families of columns.

    Timers are looked at by batches with readings, of whatever recording: else
    they would make empty batches without end, and a query over what is there
    now would never be done.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


class _Timed(StatefulProcessor):
    """A processor with one timer a key, set anew by every batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def wait(self, timers, ms: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + ms)

    def close(self) -> None:
        pass


class _Watcher(_Timed):
    """:class:`SetState` between batches: its numbers as one value, its counts as a map."""

    TYPES = {"bool": "boolean", "int": "long", "float": "double", "list[float]": "array<double>"}
    PLAIN = {"bool": bool, "int": int, "float": float, "list[float]": list}
    FIELDS = [f for f in fields(SetState) if f.name != "counts"]

    def __init__(self, idle_ms: int, forget_ms: int):
        self.idle_ms, self.forget_ms = idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.machine = handle.getValueState("machine", ", ".join(f"{f.name} {self.TYPES[f.type]}" for f in self.FIELDS))
        self.counts = handle.getMapState("counts", "value double", "n long")

    def _load(self) -> SetState:
        state = dict(zip([f.name for f in self.FIELDS], self.machine.get()))
        counted = not state["calibrated"] and state["finished_at"] < 0
        return SetState(**{**state, "recent": list(state["recent"])}, counts={k[0]: v[0] for k, v in self.counts.iterator()} if counted else {})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("time_s")
        state = self._load() if self.machine.exists() else _start(batch)
        over, known = state.finished_at >= 0, dict(state.counts)
        for t, v in batch[["time_s", "value"]].itertuples(index=False, name=None):
            state.observe(max(t, state.last), v)
        for value, n in state.counts.items():
            if known.get(value) != n:
                self.counts.updateValue((value,), (n,))
        if state.finished_at >= 0:
            self.counts.clear()
        self.machine.update(tuple(self.PLAIN[f.type](getattr(state, f.name)) for f in self.FIELDS))
        self.wait(timerValues, self.forget_ms if state.finished_at >= 0 else self.idle_ms)
        if not over:
            yield _row(key[0], state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._load()
        over = state.finished_at >= 0
        state.abandon()
        self.machine.clear()
        self.counts.clear()
        if not over:
            yield _row(key[0], state)


def watch(readings: DataFrame, baseline: float | None = None, signal_range: float | None = None, forget_ms: int = FORGET_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """The same on a stream: after every batch, the state of each recording that had readings and was not finished before it.

    So a finished set is given once, by the batch that ends it.  Readings of one
    batch are put in order of time; a reading older than the last one seen counts
    as of that one's time.  Calibration is that of a recording's first reading.
    A set whose readings stop for ``idle_ms`` of processing time is given a last
    time, by the next batch that has readings of any recording: ``finished`` with
    its last reading if it was armed, else ``cancelled``.
    What is left of a finished set's state leaves the store ``forget_ms`` after
    its last reading; a reading after that begins another set.  The session is set
    to the state store that maps and timers need.
    """
    _store(readings.sparkSession)
    kind = readings.schema["recording_id"].dataType.simpleString()
    return _calibrated(readings, baseline, signal_range).groupBy("recording_id").transformWithStateInPandas(_Watcher(idle_ms, forget_ms), _RESULT.format(id=kind), "Update", "ProcessingTime")


class _Counter(_Timed):
    """The samples of each set so far, and its repetitions after every batch."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.samples = handle.getListState("samples", "time_s double, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).dropna(subset=["time_s", "value"])[["time_s", "value"]]
        self.samples.appendList([tuple(map(float, r)) for r in fresh.itertuples(index=False, name=None)])
        t, v = np.array(list(self.samples.get()) or np.empty((0, 2)), float).T
        order = np.argsort(t, kind="stable")
        whole, valleys = live.repetitions(t[order], v[order])
        self.wait(timerValues, self.idle_ms)
        yield pd.DataFrame({"recording_id": [key[0]], "samples": [len(t)], "threshold_reps": [len(whole)], "valley_reps": [len(valleys)], "last_end": pd.Series([valleys[-1][1] if valleys else None], dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.samples.clear()
        yield from ()


def provisional_counts(readings: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """After every batch, the repetitions of each recording that had readings, counted over all it has had.

    They are those of the batch detectors over the same readings in order of
    time, with thresholds of the whole.  The samples of a set are kept until none
    has come for ``idle_ms`` of processing time.
    """
    _store(readings.sparkSession)
    kind = readings.schema["recording_id"].dataType.simpleString()
    plain = readings.select("recording_id", F.col("time_s").cast("double"), F.col("value").cast("double"))
    return plain.groupBy("recording_id").transformWithStateInPandas(_Counter(idle_ms), f"recording_id {kind}, samples long, threshold_reps long, valley_reps long, last_end double", "Update", "ProcessingTime")


def without_stale_start(readings: DataFrame) -> DataFrame:
    """Readings ``recording_id, seq, host_ms, device_ms`` without opening ones left over from an earlier run.

    An opening reading is stale if the device's clock jumps by more than
    ``STALE_DEVICE_MS`` after it within ``STALE_HOST_MS`` of host time; what
    comes next is then the opening one, and may be stale too.
    """
    w = Window.partitionBy("recording_id").orderBy("seq")
    jump = (F.lead("device_ms").over(w) - F.col("device_ms") > STALE_DEVICE_MS) & (F.lead("host_ms").over(w) - F.col("host_ms") <= STALE_HOST_MS)
    rows = readings.withColumn("_stale", F.coalesce(jump, F.lit(False)))
    before = F.min(F.when(~F.col("_stale"), F.col("seq"))).over(Window.partitionBy("recording_id"))
    return rows.withColumn("_from", before).filter(F.col("seq") >= F.col("_from")).drop("_stale", "_from")


def write_once(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Each finished set is written once: a batch has a folder of its own, which a repeated batch overwrites."""
    def save(batch: DataFrame, number: int) -> None:
        batch.filter(F.col("status") == "finished").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
