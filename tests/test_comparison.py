"""Set metrics, calibration quality, metadata and detectors against values worked out by hand or one by one."""

import statistics

import pytest
from pyspark.sql import functions as F

from tidewater.operators import calibration, compare, metrics
from tidewater.plans import analysis

from .test_detect import HEIGHTS, REST, bumps, frame


def test_metrics_of_a_set(spark):
    rows = [("a", 1, 0.0, 2.0, 2.0, 450.0, 225.0, 300.0), ("a", 2, 3.0, 4.0, 1.0, 100.0, 100.0, 120.0), ("a", 3, 5.0, 9.0, 4.0, 200.0, 50.0, 90.0)]
    measured = spark.createDataFrame(rows, "recording_id string, rep_no long, start_time double, end_time double, duration double, integral double, mean_activation double, peak_value double")
    for c in ("mean_activation", "integral", "peak_value"):
        measured = measured.withColumn(f"norm_{c}", F.col(c) / 10)
    facts = spark.createDataFrame([("a", 1.0, 300.0, 12.0, True), ("none", 5.0, 6.0, 20.0, True), ("bare", 5.0, 6.0, 21.0, False)], "recording_id string, raw_min double, raw_max double, recording_duration double, calibration_usable boolean")
    got = {r.recording_id: r for r in metrics.set_metrics(measured, facts).collect()}
    a = got["a"]
    assert (a.rep_count, a.active_time, a.set_duration, a.total_integral) == (3, 7.0, 9.0, 750.0)
    assert a.mean_activation == pytest.approx(750 / 7, abs=1e-6) and a.median_activation == 100 and a.peak_activation == 300
    assert (a.early_mean, a.late_mean, a.change, a.slope) == (225, 75, -150, -87.5)
    d = statistics.pstdev([2, 1, 4])
    assert a.duration_deviation == pytest.approx(d, abs=1e-6) and a.duration_variation == pytest.approx(d / (7 / 3) * 100, abs=1e-5) and a.median_duration == 2
    assert (a.norm_mean_activation, a.norm_median_activation, a.norm_peak_activation, a.norm_integral) == (pytest.approx(75 / 7, abs=1e-6), 10, 30, 75)
    n = got["none"]
    assert (n.rep_count, n.set_duration, n.mean_activation, n.median_activation, n.early_mean, n.slope) == (0, 20.0, 0, 0, None, None)
    assert (n.norm_mean_activation, n.norm_median_activation, n.norm_peak_activation, n.norm_integral) == (None, 0, None, 0)
    assert got["bare"].norm_median_activation is None and got["bare"].norm_integral is None


def test_sets_from_samples(spark):
    made = {"set": REST + bumps(HEIGHTS, 70, 2.4, 1.8) + REST, "still": [50.0] * 80}
    cal = spark.createDataFrame([("set", 70.0, 570.0, 500.0, None, "c.csv"), ("still", 1.0, 1.5, 0.5, True, "d.csv")], "recording_id string, baseline double, max_flex double, signal_range double, usable boolean, source_csv string")
    got = {r.recording_id: r for r in analysis.set_analysis(frame(spark, made), cal).collect()}
    s = got["set"]
    assert s.rep_count == len(HEIGHTS) and s.calibration_usable and s.peak_activation == pytest.approx(max(HEIGHTS))
    assert s.norm_peak_activation == pytest.approx((max(HEIGHTS) - 70) / 5) and s.norm_mean_activation == pytest.approx((s.mean_activation - 70) / 5, abs=1e-3)
    assert got["still"].rep_count == 0 and not got["still"].calibration_usable and got["still"].set_duration == pytest.approx(7.9)


GRADES = [
    # max activation, share of all, share in repetitions, usable, range -> level, across sessions, number of reasons
    (100.0, 0.0, 0.0, True, 50.0, "ok", True, 0), (100.1, 0.001, 0.0, True, 50.0, "mild", True, 1), (150.0, 0.10, 0.24, None, 50.0, "mild", True, 1), (150.0, 0.10, 0.25, True, 50.0, "moderate", True, 2),
    (200.0, 0.01, 0.02, True, 50.0, "moderate", True, 2), (150.0, 0.50, 0.10, True, 50.0, "severe", False, 3), (150.0, 0.20, 0.50, True, 50.0, "severe", False, 3), (300.0, 0.01, 0.01, True, 50.0, "severe", False, 3),
    (None, 0.0, 0.0, False, 50.0, "unusable", False, 1), (None, 0.0, 0.0, None, 0.99, "unusable", False, 1),
]


def test_grades_of_calibrations(spark):
    rows = [(i, 5.0, 60.0, g[4], g[3], "c.csv", *g[:3]) for i, g in enumerate(GRADES)] + [(99, None, None, None, None, None, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "recording_id long, baseline double, max_flex double, signal_range double, usable boolean, source_csv string, max_activation double, over_fraction double, rep_over_fraction double")
    got = {r.recording_id: r for r in calibration.grade(df).withColumn("signature", calibration.signature()).collect()}
    assert [(got[i].level, got[i].cross_session, len(got[i].reasons)) for i in range(len(GRADES))] == [g[5:] for g in GRADES]
    assert got[99].level == "missing" and not got[99].cross_session and got[99].signature is None
    assert tuple(got[0].signature) == ("c.csv", 5.0, 50.0) and got[8].signature is None


def test_use_counts_repetitions_by_themselves(spark):
    df = spark.createDataFrame([("r", float(t), a) for t, a in enumerate([10.0, 120.0, 130.0, 90.0, 20.0, 20.0, 20.0, 20.0])], "recording_id string, time_s double, activation double")
    reps = spark.createDataFrame([("r", 1, 1.0, 2.0), ("r", 2, 2.0, 3.0)], "recording_id string, rep_no long, start_time double, end_time double")
    (r,) = calibration.use_of(df, reps).collect()
    assert (r.max_activation, r.over_fraction, r.rep_over_fraction) == (130.0, 0.25, 0.75)  # the shared end counts for both


def test_nine_fields_of_metadata(spark):
    fields = compare.STRICT_FIELDS + compare.OPTIONAL_FIELDS
    assert len(fields) == 9
    same = {f: "x" for f in fields}
    cases = {"same": (same, same, "")}
    for f in fields:
        cases[f"{f} differs"] = (same, {**same, f: "y"}, f"{f} differs: x / y")
        cases[f"{f} empty"] = (same, {**same, f: " "}, f"{f} missing" if f in compare.STRICT_FIELDS else "")
        cases[f"{f} null"] = ({**same, f: None}, {**same, f: None}, f"{f} missing" if f in compare.STRICT_FIELDS else "")
    schema = ", ".join(["name string", *[f"{s}_{f} string" for s in "ab" for f in fields]])
    rows = [(k, *[a[f] for f in fields], *[b[f] for f in fields]) for k, (a, b, _) in cases.items()]
    got = {r["name"]: (r.warnings, r.compatible_metadata) for r in compare.metadata_warnings(spark.createDataFrame(rows, schema)).collect()}
    assert got == {k: (w, not w) for k, (_, _, w) in cases.items()}
    bare = spark.createDataFrame([("x", "left", "left")], "name string, a_side string, b_side string")
    assert compare.metadata_warnings(bare).first().warnings == "participant_id missing; muscle missing; exercise_name missing; weight missing"


def test_differences_of_metrics(spark):
    columns = compare.RAW_COMPARED + compare.NORM_COMPARED
    sets = spark.createDataFrame([("a", *[10.0] * len(columns)), ("b", *[15.0] * (len(columns) - 1), None), ("c", *[0.0] * len(columns))], ", ".join(["recording_id string", *[f"{c} double" for c in columns]]))
    pairs = spark.createDataFrame([("a", "b", True), ("a", "c", False)], "newer string, older string, allowed boolean")
    got = {(r.older, r.metric): (r.a, r.b, r.delta, r.percent) for r in compare.metric_differences(pairs, sets).collect()}
    assert len(got) == 15 + 9
    assert got["b", "slope"] == (10, 15, 5, 50) and got["b", "norm_slope"] == (10, None, None, None) and got["c", "slope"] == (10, 0, -10, 0)


def test_matched_repetitions(spark):
    rows = [("a", i, p, p / 2) for i, p in enumerate((100.0, 90.0, 80.0, 70.0), 1)] + [("b", i, p, p / 2) for i, p in enumerate((50.0, 60.0), 1)] + [("c", 1, 1.0, 1.0), ("c", 2, 1.0, 1.0)]
    reps = spark.createDataFrame(rows, "recording_id string, rep_no long, peak_value double, mean_value double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "newer string, older string")
    (r,) = compare.matched_reps(pairs, reps).collect()
    assert (r.newer, r.matched_reps, r.a_avg_peak, r.b_avg_peak, r.a_peak_drop, r.b_peak_drop) == ("a", 2, 95, 55, 10, -20)
    assert (r.matched_activation, r.matched_peak, r.matched_fatigue, r.matched_fatigue_points) == ("Set 1", "Set 1", "Set 1", 30)
    assert r.matched_peak_difference == pytest.approx(40 / 55 * 100, abs=1e-6)


def test_two_detectors_and_what_was_expected(spark):
    made = {"apart": REST + bumps(HEIGHTS, 70, 2.4, 1.8) + REST, "held": [30.0] * 20 + bumps((900, 940, 980, 900), 320, 4.0) + [30.0] * 20, "flat": [5.0] * 50}
    rows = analysis.smoothed(frame(spark, made))
    limits = analysis.full_thresholds(rows)
    from tidewater.operators import detect, hybrid

    regions = detect.detect(rows, limits)
    told = spark.createDataFrame([("apart", "7 "), ("held", "4"), ("flat", None)], "recording_id string, expected_reps string")
    got = {r.recording_id: r for r in compare.agreement(regions, hybrid.detect(rows, limits, regions).filter("kind = 'rep'"), told).collect()}
    assert [(got[k].threshold_reps, got[k].valley_reps, got[k].agree, got[k].threshold_as_expected, got[k].valley_as_expected) for k in ("apart", "held", "flat")] == [(7, 7, True, True, True), (1, 4, False, False, True), (0, 0, True, True, True)]
    assert got["held"].threshold_intervals.count("-") == 1 and got["held"].valley_intervals.count(", ") == 3
