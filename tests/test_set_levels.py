"""Readings of a live set are smoothed, and levels follow each recording's calibration or its readings so far."""

import random

import pytest

from tidewater.streaming import lifecycle

from .test_low_tail import levels


def noisy(offset, seed, parts=((60, 3), (0, 3)) * 4 + ((0, 14),), step=0.1):
    rng, out = random.Random(seed), []
    for value, seconds in parts:
        out += [offset + value + rng.gauss(0, 8) for _ in range(int(seconds / step))]
    return [(round(i * step, 6), round(v, 3)) for i, v in enumerate(out)]


def expected(readings, calibration=None):
    """Activity at every reading, from all readings before it."""
    on, out, values = False, [], []
    for _, v in readings:
        values.append(v)
        smooth = sum(values[-15:]) / len(values[-15:])
        enter, leave = (calibration[0] + 0.12 * calibration[1], calibration[0] + 0.075 * calibration[1]) if calibration else levels(values)
        on = smooth > leave if on else smooth >= enter
        out.append(on)
    return out


@pytest.mark.parametrize("calibration", [None, (300.0, 40.0), (290.0, 400.0)])
def test_activity_of_noisy_signals_with_an_offset(calibration):
    readings = noisy(300, 5)
    state, want = lifecycle.SetState(**(lifecycle.levels(*calibration) if calibration else {})), expected(readings, calibration)
    for (t, v), on in zip(readings, want):
        state.observe(t, v)
        if state.finished_at >= 0:
            break
        assert state.active == on
    assert any(want) and not all(want)


def test_calibrated_levels_have_no_floor():
    made = lifecycle.levels(100, 50)
    assert made["enter"] == pytest.approx(106) and made["leave"] == pytest.approx(103.75)


def test_calibration_of_each_recording_on_tables_and_streams(spark, tmp_path):
    sets = {"none": noisy(300, 1), "own": noisy(300, 2), "unusable": noisy(40, 3), "fourth": [(t, None) if i % 50 == 9 else (t, v) for i, (t, v) in enumerate(noisy(0, 4))]}
    df = spark.createDataFrame([(k, t, v) for k, r in sets.items() for t, v in r], "recording_id string, time_s double, value double")
    known = spark.createDataFrame([("own", 300.0, 70.0, True), ("unusable", 900.0, 0.0, False)], "recording_id string, baseline double, signal_range double, usable boolean")
    both = lifecycle.with_calibration(df, known)
    want = {r.recording_id: r for r in lifecycle.replay(both).collect()}
    for k, cal in (("none", None), ("own", (300.0, 70.0)), ("unusable", None)):
        state = lifecycle.SetState(**(lifecycle.levels(*cal) if cal else {}))
        for t, v in sets[k]:
            state.observe(t, v)
        assert (want[k].status, want[k].episodes, want[k].finished_at) == ("finished", state.episodes, state.finished_at)
    for i in range(3):
        both.filter(f"cast(time_s / 13 as int) {'=' if i < 2 else '>='} {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lifecycle.watch(stream).writeStream.outputMode("update").format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.sql("select * from levels").collect():
        if r.recording_id not in last or r.readings >= last[r.recording_id].readings:
            last[r.recording_id] = r
    assert {k: (r.status, r.readings, r.episodes, r.finished_at) for k, r in last.items()} == {k: (r.status, r.readings, r.episodes, r.finished_at) for k, r in want.items()}
