"""Readers, lines and clocks."""

import pytest

from tidewater.sources import signals


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time_ms,signal_value,emg_value\n0,1.5,9\n20,2.5,9\n10,3.5,9\n")
    (tmp_path / "b.csv").write_text("time_ms,signal_value,emg_value\n0,7,9\n")
    rows = sorted(map(tuple, signals.read_signals(spark, str(tmp_path)).collect()))
    assert rows == [("a", 0, 0.0, 1.5), ("a", 1, 0.02, 2.5), ("a", 2, 0.01, 3.5), ("b", 0, 0.0, 7.0)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.csv").write_text("time_ms,emg_value\n0,1\nx,2\n20,\n30,4.0\n")
    assert [tuple(r) for r in signals.read_replay(spark, str(tmp_path / "c")).orderBy("seq").collect()] == [("d", 0, 0.0, 1.0, "1"), ("d", 1, 0.03, 4.0, "4.0")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        signals.read_signals(spark, str(tmp_path / "c")).collect()
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "f.csv").write_text("time_ms,x\n0,1\n")
    with pytest.raises(ValueError):
        signals.read_signals(spark, str(tmp_path / "e"))


def test_lines(spark):
    cases = {
        "": (None, None), "not-a-number": (None, None), "123,not-a-number": (None, None), "456,789": (456, 789.0), "321": (None, 321.0), "7.9,8.9": (7, 8.9), "x,5": (None, 5.0),
        " 1 , , 2.5 ,": (1, 2.5), ",,": (None, None), "3d": (None, None), "4,1e2": (4, 100.0), "5,1,2": (5, 2.0),
    }
    got = signals.parse_lines(spark.createDataFrame([(x,) for x in cases], "line string")).collect()
    assert {r.line: (r.device_time_ms, r.value) for r in got} == cases


def test_clock(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([4294967290, 4, 14, 4294967295, 1])], "recording_id string, seq long, device_time_ms long")
    assert [r.device_time_ms for r in signals.unwrap_clock(df).orderBy("seq").collect()] == [4294967290, 4294967300, 4294967310, 8589934591, 8589934593]


def test_clock_steps_back(spark):
    times = [100, 90, 95, 100, 4294967290, 4294967280, 5, 3, None, 7]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)] + [("b", 0, 50), ("b", 1, 40), ("b", 2, 60)], "recording_id string, seq long, device_time_ms long")
    got = signals.unwrap_clock(df).orderBy("recording_id", "seq").collect()
    assert [r.device_time_ms for r in got] == [100, None, None, 100, 4294967290, None, 4294967301, None, None, 4294967303, 50, None, 60]


def test_write_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 0.0, 1.0)], "recording_id string, seq long, time_s double, raw double")
    signals.write_recordings(df, str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(Exception):
        signals.write_recordings(df, str(tmp_path / "out"), 2)
    (tmp_path / "r1_metadata.json").write_text('{"exercise_name": "curl",\n "side": "left"}')
    r = signals.read_metadata(spark, str(tmp_path / "r1_metadata.json")).collect()[0]
    assert r.recording_id == "r1" and r.metadata == {"exercise_name": "curl", "side": "left"}
