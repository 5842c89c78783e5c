"""The live set's state machine, on tables and on streams."""

import pytest

from tidewater.streaming import lifecycle

LEVELS = lifecycle.levels(100, 1000)


def feed(parts, step=0.25):
    """Readings of ``(value, seconds)`` parts."""
    out, t = [], 0.0
    for value, seconds in parts:
        for _ in range(int(seconds / step)):
            out.append((round(t, 6), float(value)))
            t += step
    return out


THREE = [(500, 2), (100, 2)] * 3
CASES = {"finished": feed([*THREE, (100, 11)]), "resting": feed([(100, 30)]), "pausing": feed([*THREE, (100, 4), (500, 3)]), "single": feed([(500, 2), (100, 20)]), "long": feed([(500, 9), (100, 12)])}


def test_ends_of_sets():
    got = {}
    for name, readings in CASES.items():
        state = lifecycle.SetState(**LEVELS)
        for t, v in readings:
            state.observe(t, v)
        got[name] = state.status
    assert got == {"finished": "finished", "resting": "recording", "pausing": "recording", "single": "recording", "long": "finished"}


def test_replay_and_stream_agree(spark, tmp_path):
    rows = [(k, t, v) for k, r in CASES.items() for t, v in r]
    df = spark.createDataFrame(rows, "recording_id string, time_s double, value double")
    want = {r.recording_id: r for r in lifecycle.replay(df, 100, 1000).collect()}
    for i in range(3):
        df.filter(f"cast(time_s / 8 as int) {'=' if i < 2 else '>='} {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lifecycle.watch(stream, 100, 1000).writeStream.outputMode("update").format("memory").queryName("sets").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.sql("select * from sets").collect():
        if r.recording_id not in last or r.readings >= last[r.recording_id].readings:
            last[r.recording_id] = r
    assert {k: (r.status, r.readings, r.episodes) for k, r in last.items()} == {k: (r.status, r.readings, r.episodes) for k, r in want.items()}
    # readings are smoothed over the last 15, so the set ends later than the raw values would have it
    assert want["finished"].status == "finished" and want["finished"].finished_at == smoothed_end(CASES["finished"])


def smoothed_end(readings, enter=220.0, leave=175.0):
    """When a set that is armed in time ends, from the definition."""
    values, active, last, idle = [], False, None, None
    for t, v in readings:
        values.append(v)
        mean = sum(values[-15:]) / len(values[-15:])
        active = mean > leave if active else mean >= enter
        if active:
            last, idle = t, None
        elif last is not None and t >= 10 and t - last >= 1.25:
            idle = t if idle is None else idle
            if t - idle >= 6:
                return t


def test_a_finished_set_is_written_once(spark, tmp_path):
    rows = [("a", t, v) for t, v in CASES["finished"] + [(x / 4, 100.0) for x in range(100, 140)]]
    df = spark.createDataFrame(rows, "recording_id string, time_s double, value double")
    for i, part in enumerate(("time_s < 12", "time_s >= 12 and time_s < 22", "time_s >= 22 and time_s < 26", "time_s >= 26")):
        df.filter(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = lifecycle.write_once(lifecycle.watch(stream, 100, 1000), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.recording_id, r.status) for r in got] == [("a", "finished")]


def test_transitions():
    assert lifecycle.transition("recording", "possible_end") == "possible_end"
    with pytest.raises(ValueError):
        lifecycle.transition("idle", "finished")


def test_stale_openings(spark):
    rows = [("a", 0, 1000, 90), ("a", 1, 1000, 1395100), ("a", 2, 1000, 1395110), ("b", 0, 0, 0), ("b", 1, 6000, 6000), ("c", 0, 5, 0), ("c", 1, 6, 9000), ("c", 2, 7, 90000)]
    df = spark.createDataFrame(rows, "recording_id string, seq long, host_ms long, device_ms long")
    got = sorted((r.recording_id, r.seq) for r in lifecycle.without_stale_start(df).collect())
    assert got == [("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 2)]


SCHEMA = "recording_id string, time_s double, value double"


def streamed(spark, tmp_path, make, rows):
    """What a query gives for more ``rows``; it goes on from where it stopped before."""
    source, out = tmp_path / "in", []
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    q = make(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60) and q.exception() is None
    return out


def test_sets_whose_readings_stop_leave_the_store(spark, tmp_path):
    rows = lambda k, readings: [(k, t, v) for t, v in readings]
    armed, never, done = feed([*THREE, (100, 3)]), feed([(100, 5)]), CASES["finished"]
    make = lambda s: lifecycle.watch(s, 100, 1000, forget_ms=1, idle_ms=1)
    first = streamed(spark, tmp_path, make, rows("armed", armed) + rows("never", never) + rows("done", done))
    later = [r for r in streamed(spark, tmp_path, make, [("other", 0.0, 100.0)]) if r.recording_id != "other"]
    told = lambda out: {r.recording_id: (r.status, r.finished_at) for r in out}
    assert len(first) == 3 and told(first) == {"never": ("recording", None), "armed": ("possible_end", None), "done": ("finished", smoothed_end(done))}
    assert len(later) == 2 and told(later) == {"never": ("cancelled", never[-1][0]), "armed": ("finished", armed[-1][0])}
    again = [r for r in streamed(spark, tmp_path, make, [("never", 100.0, 100.0)]) if r.recording_id == "never"]
    assert [(r.status, r.readings) for r in again] == [("recording", 1)]  # nothing is left of the first


def test_counts_of_a_growing_set_are_those_of_the_batch_detectors(spark, tmp_path):
    from tidewater.operators import detect, hybrid
    from tidewater.plans import analysis

    from .test_detect import HEIGHTS, REST, bumps

    made = {"apart": REST + bumps(HEIGHTS, 70, 2.4, 1.8) + REST, "held": [30.0] * 20 + bumps((900, 940, 980, 900), 320, 4.0) + [30.0] * 20, "flat": [5.0] * 90}
    cuts = (0, 2, 45, 120, 200, 400)
    batches = [[(k, round(i * 0.1, 9), v) for k, vs in made.items() for i, v in enumerate(map(float, vs)) if a <= i < b] for a, b in zip(cuts, cuts[1:])]
    for end, rows in zip(cuts[1:], batches):
        batch = streamed(spark, tmp_path, lifecycle.provisional_counts, rows)
        prefix = [(k, i, round(i * 0.1, 9), v) for k, vs in made.items() for i, v in enumerate(map(float, vs[:end]))]
        rows = analysis.smoothed(spark.createDataFrame(prefix, "recording_id string, seq long, time_s double, raw double"))
        limits = analysis.full_thresholds(rows)
        regions = detect.detect(rows, limits)
        want = {k: [0, 0] for k in made}
        for i, d in enumerate((regions, hybrid.detect(rows, limits, regions).filter("kind = 'rep'"))):
            for r in d.groupBy("recording_id").count().collect():
                want[r[0]][i] = r[1]
        for r in batch:
            assert [r.threshold_reps, r.valley_reps] == want[r.recording_id] and r.samples == len(made[r.recording_id][:end])
    assert want["apart"] == [7, 7] and want["held"] == [1, 4]


def test_state_holds_values_not_readings():
    state = lifecycle.SetState()
    for i in range(20_000):
        state.observe(i / 100, float(i * 7 % 50))
    assert len(state.counts) == 50 and sum(state.counts.values()) == 20_000 and len(state.recent) == 15
