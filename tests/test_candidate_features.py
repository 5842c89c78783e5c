"""Features of candidate cuts, as the classifiers take them."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidewater.operators import hybrid, smoothing, detect
from tidewater.plans import classify

STEP = 0.1


def curve(heights, seconds=4.0):
    """Contractions of these heights without rest between them."""
    n = int(seconds / STEP)
    body = [300 + h * math.sin(math.pi * (i + 0.5) / n) ** 2 for h in heights for i in range(n)]
    return [0.0] * 30 + body + [0.0] * 30


def side(values, start):
    """Longest time above, and area over, the high level, one sample after the other."""
    high, longest, run = start + (max(values) - start) * 0.65, 0, 0
    for v in values:
        run = run + 1 if v >= high else 0
        longest = max(longest, run - 1)
    return longest * STEP, sum(max(0.0, v - high) for v in values) * STEP if len(values) > 1 else 0.0


def test_evidence_of_both_sides_of_each_candidate():
    v = np.array(curve((900, 1500, 700, 1200)))
    a, b, start = 30, 189, 250.0
    t, v = np.arange(len(v))[a : b + 1] * STEP, v[a : b + 1]
    rows = [r for r in hybrid.split_region(t, v, v, start, 120.0, float(v.max()), features=True) if r["kind"] == "candidate"]
    candidates = [{"i": round((r["start_time"] - t[0]) / STEP), "features": r, "reasons": r["reasons"]} for r in rows]
    assert len({c["i"] for c in candidates}) >= 3
    for c in candidates:
        left, right = side(v[: c["i"] + 1], start), side(v[c["i"] :], start)
        got = c["features"]
        assert np.isclose(got["plateau_support"], left[0] + right[0]) and np.isclose(got["high_activation_area"], left[1] + right[1])
        assert np.isclose(got["left_segment_duration"], c["i"] * STEP) and np.isclose(got["right_segment_duration"], (b - a - c["i"]) * STEP)
    assert len({c["features"]["high_activation_area"] for c in candidates if not c["reasons"]}) > 1
    assert all(3.9 <= c["features"]["local_cycle_duration_estimate"] <= 4.1 for c in candidates)


def test_classifiers_take_the_features_as_they_are(spark):
    rows = [(k, i, i * STEP, v) for k in range(12) for i, v in enumerate(curve((900 + 40 * k, 1500, 700 + 30 * k, 1200)))]
    signal = spark.createDataFrame(rows, "recording_id long, seq long, time_s double, raw double").withColumn("smooth", F.col("raw"))
    limits = smoothing.thresholds(signal)
    found = hybrid.candidate_features(signal, limits, detect.detect(signal, limits))
    assert set(classify.FEATURES) <= set(found.columns)
    labelled = found.withColumns({"session_id": F.col("recording_id"), "participant_id": F.col("recording_id") % 6, "human_label": F.when(F.col("item") % 2 == 0, "true_boundary").otherwise("false_boundary")})
    out = classify.numeric_rows(labelled).collect()
    assert len(out) >= 36 and all(r[c] is not None for r in out for c in classify.FEATURES)
    assert {r["by"] for r in classify.experiment(labelled)["metrics"].collect()} == {"model", "rule"}
