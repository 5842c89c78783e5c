"""Catalogue, sessions, annotations and time stamps on files and small tables."""

import json

import pytest

from tidewater.operators import compare, quality
from tidewater.sources import catalog, sessions
from tidewater.streaming import timing


def test_scan(spark, tmp_path):
    for name, meta in {"a": {"data_type": "real", "test_type": "workout_set"}, "b": {"data_type": "real", "test_type": "workout_set", "excluded": "Excluded"}, "c": None, "d": {"test_type": "calibration", "notes": "diagnostic"}}.items():
        (tmp_path / f"{name}.csv").write_text("time_ms,emg_value\n0,1\n")
        if meta:
            (tmp_path / f"{name}_metadata.json").write_text(json.dumps(meta))
    found = catalog.scan(spark, str(tmp_path))
    assert {r.recording_id: r.has_metadata for r in found.collect()} == {"a": True, "b": True, "c": False, "d": True}
    assert [r.recording_id for r in catalog.workouts(found).collect()] == ["a"] and [r.recording_id for r in catalog.calibrations(found).collect()] == ["d"]
    before = catalog.source_hashes(spark, str(tmp_path / "*.csv"))
    kept = spark.createDataFrame(before.collect(), before.schema)
    (tmp_path / "a.csv").write_text("time_ms,emg_value\n0,2\n")
    changed = [r.path.rsplit("/", 1)[-1] for r in catalog.changed_sources(kept, catalog.source_hashes(spark, str(tmp_path / "*.csv"))).collect()]
    assert changed == ["a.csv"]
    with pytest.raises(ValueError):
        catalog.require_other_path(str(tmp_path / "a.csv"), kept)
    catalog.require_other_path(str(tmp_path / "z.csv"), kept)


def test_sessions(spark, tmp_path):
    for name, manifest, notes in (("s1", {"session_id": "s1", "planned_reps": 3}, {"annotation_status": "locked", "actual_reps": 1, "verified_rep_intervals": [{"rep_number": 1, "start_time": 0.5, "end_time": 1}]}), ("s2", {"session_id": "s2"}, None), ("s3", "{broken", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(manifest if isinstance(manifest, str) else json.dumps(manifest))
        if notes:
            (tmp_path / name / "annotations.json").write_text(json.dumps(notes, indent=1))
    got = {r.session_id: r for r in sessions.read_sessions(spark, str(tmp_path)).collect()}
    assert set(got) == {"s1", "s2"} and got["s2"].annotation_status == "unreviewed" and got["s2"].verified_rep_intervals == []
    assert got["s1"].annotation_status == "locked" and got["s1"].planned_reps == 3 and got["s1"].verified_rep_intervals[0].end_time == 1.0


def test_candidate_table(spark, tmp_path):
    row = {c: str(i) for i, c in enumerate(sessions.CANDIDATE_COLUMNS)} | {"matching_error": None}
    sessions.write_candidates(spark.createDataFrame([row], ", ".join(f"{c} string" for c in row)), str(tmp_path / "c"))
    back = sessions.read_candidates(spark, str(tmp_path / "c"))
    assert back.columns == list(sessions.CANDIDATE_COLUMNS) and len(back.columns) == 24
    r = back.collect()[0]
    assert r.session_id == "0" and (r.matching_error or "") == ""
    spark.createDataFrame([(1,)], "x int").write.option("header", True).csv(str(tmp_path / "d"))
    with pytest.raises(ValueError):
        sessions.read_candidates(spark, str(tmp_path / "d"))


def test_json_without_odd_numbers(spark):
    rows = spark.createDataFrame([(1.5, float("nan"), "x"), (float("inf"), 2.0, None)], "b double, a double, c string")
    assert sorted(r.json for r in sessions.as_json(rows).collect()) == ['{"a":2.0,"b":null,"c":null}', '{"a":null,"b":1.5,"c":"x"}']


def test_payloads(spark):
    s = spark.createDataFrame([("ok", 10.0, "2"), ("count", 10.0, "0"), ("word", 10.0, "x"), ("unset", 10.0, None), ("late", 10.0, "1"), ("empty", 10.0, "0")], "session_id string, max_time double, actual_reps string")
    reps = [("ok", 1, 1, "0", "1"), ("ok", 2, 2, "1", "2"), ("count", 1, 1, "0", "1"), ("word", 1, 1, "0", "1"), ("unset", 1, 1, "0", "1"), ("late", 1, 2, "9", "11")]
    false = [("ok", 1, "3", "4"), ("unset", 1, "5", "4")]
    r = spark.createDataFrame(reps, "session_id string, row_no int, rep_number int, start_time string, end_time string")
    f = spark.createDataFrame(false, "session_id string, row_no int, start_time string, end_time string")
    got = {x.session_id: (x.n_errors, x.errors) for x in quality.payload_errors(s, r, f).collect()}
    assert got["ok"] == (0, "") and got["empty"] == (0, "") and got["count"] == (1, "actual_reps differs from the rows") and got["word"] == (1, "actual_reps is no whole number")
    assert got["unset"] == (1, "false intervals: row 1: start not before end") and got["late"][0] == 2


def test_timing(spark):
    rows = [("a", 0, 1000, None), ("a", 1, 1100, 50), ("a", 2, 1200, 150), ("a", 3, 2700, 160), ("a", 4, 2800, 40), ("a", 5, 2900, 6000), ("b", 0, 7, None), ("b", 1, 9, None)]
    got = timing.sample_timing(spark.createDataFrame(rows, "recording_id string, seq long, host_ms long, device_ms long")).orderBy("recording_id", "seq").collect()
    assert [(r.time_ms, r.drift_ms, r.gap_ms, r.drift_warning) for r in got] == [(0, None, None, False), (0, 100, None, False), (100, 100, None, False), (110, 1590, None, True), (0, 1800, None, True), (5950, -4050, 5960, True), (0, None, None, False), (2, None, None, False)]


def test_newest_pairs(spark):
    rows = [
        (1, "a", 5, "bi", "left", "5"), (1, "b", 4, "bi", "Left", "5"), (1, "c", 3, "bi", "left", ""), (1, "d", 2, "bi", "left", "5"),
        (2, "e", 2, "x", "", "1"), (2, "f", 1, "y", "", "1"), (3, "g", 1, "x", "", ""), (4, "h", 3, "x", "l", "1"), (4, "i", 2, "x", "l", "2"), (4, "j", 1, " x", "l ", "2"),
    ]
    got = compare.newest_pair(spark.createDataFrame(rows, "participant_id long, recording_id string, mtime long, muscle string, side string, weight string")).collect()
    assert sorted(map(tuple, got)) == [(1, "a", "c", True), (2, "e", "f", False), (4, "i", "j", True)]
