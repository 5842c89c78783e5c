"""Points in intervals, against looking at every pair."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import detect, intervals, matching


def points_and_intervals(seed):
    """Times on a coarse grid, so that many meet ends; intervals of a key may touch, and some are a single point."""
    rng = random.Random(seed)
    points = [(k, i, rng.randint(-2, 60) / 4) for k in "abc" for i in range(80)]
    spans = []
    for k in "ab":
        at = 0.0
        for n in range(1, 12):
            start = at + rng.choice([0, 0, 0.25, 1.0])
            at = start + rng.choice([0.25, 0.5, 2.0])
            spans.append((k, n, start, at, f"{k}{n}"))
    return points, spans


def frames(spark, points, spans):
    return spark.createDataFrame(points, "recording_id string, seq long, time_s double"), spark.createDataFrame(spans, "recording_id string, rep_no long, start_time double, end_time double, name string")


@pytest.mark.parametrize("half_open", [False, True])
def test_every_pair_is_found(spark, half_open):
    points, spans = points_and_intervals(1)
    p, s = frames(spark, points, spans)
    got = sorted((r.recording_id, r.seq, r.rep_no, r.name) for r in intervals.held_points(p, s, half_open=half_open).collect())
    want = sorted((k, i, n, name) for k, i, t in points for j, n, a, b, name in spans if j == k and a <= t and (t < b if half_open else t <= b))
    assert got == want and any(want.count(x) == 1 for x in want)
    ends = {(k, b) for k, _, _, b, _ in spans}
    shared = [x for x in points if (x[0], x[2]) in ends]
    assert shared  # some points lie on ends


def test_first_region_and_whole_recording(spark):
    points, spans = points_and_intervals(2)
    p, s = frames(spark, points, spans)
    whole = intervals.extent(p)
    got = {(r.recording_id, r.seq): (r.region_no, r.start_time, r.end_time) for r in matching.first_region(p, s.withColumnRenamed("rep_no", "region_no"), whole).collect()}
    assert len(got) == len(points)
    for k, i, t in points:
        held = [(n, a, b) for j, n, a, b, _ in spans if j == k and a <= t <= b]
        times = [x[2] for x in points if x[0] == k]
        assert got[k, i] == (min(held) if held else (None, min(times), max(times)))


def test_cues_end_just_before_the_next(spark):
    cues = spark.createDataFrame([("s", 1, "lift", 0.0, 2.0), ("s", 1, "lower", 2.0, 4.0), ("s", 2, "lift", 5.0, 6.0)], "session_id string, rep long, phase string, start_time double, end_time double")
    times = spark.createDataFrame([("s", t) for t in (0.0, 1.9, 2.0, 3.999, 4.0, 4.5, 5.0, 6.0)] + [("other", 1.0)], "session_id string, time_s double")
    got = {(r.session_id, r.time_s): (r.rep, r.phase) for r in intervals.active_cue(times, cues).collect()}
    assert got == {("s", 0.0): (1, "lift"), ("s", 1.9): (1, "lift"), ("s", 2.0): (1, "lower"), ("s", 3.999): (1, "lower"), ("s", 4.0): (None, None), ("s", 4.5): (None, None), ("s", 5.0): (2, "lift"), ("s", 6.0): (None, None), ("other", 1.0): (None, None)}


def test_one_long_recording_costs_no_pairs(spark):
    n, k = 400_000, 8_000
    p = spark.range(n).select(F.lit("r").alias("recording_id"), F.col("id").alias("seq"), (F.col("id") / 10).alias("time_s"), (F.col("id") % 7).cast("double").alias("raw"))
    s = spark.range(k).select(F.lit("r").alias("recording_id"), (F.col("id") + 1).alias("rep_no"), (F.col("id") * 5.0).alias("start_time"), (F.col("id") * 5.0 + 3.0).alias("end_time"))
    held = intervals.held_points(p, s)
    assert not any(x in held._jdf.queryExecution().executedPlan().toString() for x in ("Join", "Cartesian"))
    assert held.count() == 31 * k
    m = detect.measure(p, s).orderBy("rep_no").collect()
    assert len(m) == k and all(r.n_samples == 31 for r in m)
    values = [i % 7 for i in range(50, 81)]
    assert m[1].integral == pytest.approx(sum((a + b) / 2 * 0.1 for a, b in zip(values, values[1:])), abs=1e-6) and m[1].peak_time == 5.5 and m[1].mean_activation == pytest.approx(m[1].integral / 3, abs=1e-6)


def test_measures_of_repetitions(spark):
    rows = [("r", 0, 0.0, 100.0, 10.0), ("r", 1, 0.5, 200.0, 20.0), ("r", 2, 2.0, 300.0, 110.0), ("r", 3, 9.0, 50.0, 0.0)]
    df = spark.createDataFrame(rows, "recording_id string, seq long, time_s double, raw double, activation double")
    reps = spark.createDataFrame([("r", 1, 0.0, 2.0), ("r", 2, 8.0, 10.0), ("r", 3, 20.0, 30.0)], "recording_id string, rep_no long, start_time double, end_time double")
    got = {r.rep_no: r for r in detect.measure(df, reps).collect()}
    assert set(got) == {1, 2}
    assert got[1].integral == 450 and got[1].mean_activation == 225 and got[1].mean_value == 200 and got[1].median_value == 200
    assert got[1].norm_integral == pytest.approx(7.5 + 97.5) and got[1].norm_peak_value == 110
    assert got[2].integral == 100 and got[2].mean_activation == 50  # one sample counts for the whole time


def test_points_and_intervals_are_dealt_together(spark):
    points = spark.range(40).selectExpr("id % 4 as recording_id", "id as seq", "double(id) as time_s").repartition("recording_id")
    spans = spark.range(4).selectExpr("id as recording_id", "1L as rep_no", "0.0D as start_time", "99.0D as end_time").repartition("recording_id")
    held = intervals.held_points(points, spans)
    plan = held._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("Union")]
    assert "Exchange hashpartitioning" in above and held.count() == 40
