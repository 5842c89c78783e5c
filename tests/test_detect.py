"""Detectors on signals with known repetitions."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewater.operators import detect, hybrid, matching, smoothing
from tidewater.plans import analysis


def frame(spark, signals, step=0.1):
    rows = [(k, i, round(i * step, 9), float(v)) for k, vs in signals.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "recording_id string, seq long, time_s double, raw double")


def plain_detect(times, values, start, end):
    """The threshold detector by its definition, one sample after the other; (start, end) of each repetition."""
    reps, opened, quiet_until = [], None, None
    for i, (t, v) in enumerate(zip(times, values)):
        rises = v >= start if i == 0 else values[i - 1] <= start < v
        if opened is None and rises and (quiet_until is None or round(t, 6) >= round(quiet_until, 6)):
            opened = i
        if opened is not None and (v <= end or i == len(values) - 1):
            if round(t - times[opened], 6) >= 0.35:
                reps.append((opened, i))
                quiet_until = t + 0.25
            opened = None

    def facts(a, b):
        over = [max(0.0, v - start) for v in values[a : b + 1]]
        step = (times[b] - times[a]) / (b - a) if b > a else 0
        return times[b] - times[a], sum(over) * step, max(values[a : b + 1]) - start

    if len(reps) > 1:
        first, usual = facts(*reps[0]), [statistics.median(x) for x in zip(*[facts(*r) for r in reps[1:]])]
        if all(u > 0 and f < u * share for f, u, share in zip(first, usual, (0.55, 0.35, 0.55))):
            reps = reps[1:]
    return [(times[a], times[b]) for a, b in reps]


def blocks(rng, opening):
    """Plateaus of random height and length with pauses between them; a small first one if there is an ``opening``."""
    out = [0.0] * rng.randint(0, 6)
    for k in range(rng.randint(1, 6)):
        small = opening and k == 0
        out += [rng.uniform(12, 30) if small else rng.uniform(40, 120)] * (rng.randint(2, 6) if small else rng.randint(3, 25))
        out += [rng.choice([0.0, 4.0, 6.0, 9.0])] * rng.randint(1, 12)
    return out


def test_threshold_detector_on_random_plateaus(spark):
    rng = random.Random(7)
    made = {f"{i}": blocks(rng, i % 2 == 0) for i in range(60)}
    df = frame(spark, made).withColumn("smooth", F.col("raw"))
    limits = spark.createDataFrame([(k, 10.0, 5.0) for k in made], "recording_id string, start_threshold double, end_threshold double")
    got = {k: [] for k in made}
    for r in detect.detect(df, limits).orderBy("recording_id", "rep_no").collect():
        got[r.recording_id].append((r.start_time, r.end_time))
    want = {k: plain_detect([round(i * 0.1, 9) for i in range(len(v))], v, 10.0, 5.0) for k, v in made.items()}
    assert got == {k: [pytest.approx(x) for x in v] for k, v in want.items()}
    found = {k: sum(len(plain_detect([round(i * 0.1, 9) for i in range(len(v))], v, 10.0, 5.0)) for v in made.values()) for k in "x"}
    assert found["x"] > 60


def bumps(heights, low, seconds, rest=0.0, step=0.1):
    """One rise and fall for each of ``heights`` over ``low``, ``seconds`` long, with ``rest`` seconds at ``low`` between them."""
    n = round(seconds / step)
    one = lambda h: [low + (h - low) * (1 - math.cos(2 * math.pi * i / n)) / 2 for i in range(n)]
    return [v for h in heights for v in one(h) + [low] * round(rest / step)]


HEIGHTS = (610, 580, 640, 560, 600, 630, 590)
REST = [70.0] * 20
SETS = {
    "apart": REST + bumps(HEIGHTS, 70, 2.4, 1.8) + REST,
    # a long time at a level that is far below the pauses, so that thresholds over the whole are too low to tell repetitions apart
    "quiet_end": [15.0] * 10 + [210.0] * 20 + bumps(HEIGHTS * 3, 210, 3.0, 1.8) + [15.0] * 260,
    "one": REST + bumps((500,), 70, 3.0) + REST,
    "flat": [33.0] * 60,
}


def counts(spark, signals, limits_of):
    df = frame(spark, signals)
    smooth = analysis.smoothed(df)
    limits = limits_of(smooth)
    regions = detect.detect(smooth, limits)
    valleys = hybrid.detect(smooth, limits, regions).filter("kind = 'rep'")
    out = {k: [0, 0] for k in signals}
    for i, d in enumerate((regions, valleys)):
        for r in d.groupBy("recording_id").count().collect():
            out[r[0]][i] = r[1]
    return out


def test_adaptive_thresholds_ignore_a_quiet_end(spark):
    got = counts(spark, SETS, analysis.adaptive_thresholds)
    n = len(HEIGHTS)
    assert got == {"apart": [n, n], "quiet_end": [3 * n, 3 * n], "one": [1, 1], "flat": [0, 0]}
    assert counts(spark, {"quiet_end": SETS["quiet_end"]}, analysis.full_thresholds)["quiet_end"][0] < n


def test_valley_detector_splits_sustained_tension(spark):
    # repetitions that never fall back to rest: one region for thresholds, as many as there are bumps for valleys
    held = {f"{n}": [30.0] * 20 + bumps([900 + 40 * (i % 3) for i in range(n)], 320, 4.0) + [30.0] * 20 for n in (3, 5, 8)}
    got = counts(spark, held, analysis.full_thresholds)
    assert got == {k: [1, int(k)] for k in held}
    smooth = analysis.smoothed(frame(spark, held))
    limits = analysis.full_thresholds(smooth)
    ends = {k: [] for k in held}
    for r in hybrid.detect(smooth, limits, detect.detect(smooth, limits)).filter("kind = 'rep'").orderBy("start_time").collect():
        ends[r.recording_id].append(r.end_time)
    for k, v in ends.items():
        assert v[:-1] == [pytest.approx(2.0 + 4.0 * (i + 1), abs=0.35) for i in range(int(k) - 1)]  # the bumps' ends


def test_summary_of_no_repetitions(spark):
    row = analysis.summaries(frame(spark, {"flat": [120] * 42})).collect()[0]
    assert row.rep_count == 0 and row.set_duration == 0 and not row.possible_fatigue


def test_short_recordings_have_narrow_windows(spark):
    df = smoothing.centered_average(frame(spark, {"x": [0, 10, 20, 60], "y": [5]}))
    got = {(r.recording_id, r.seq): r.smooth for r in df.collect()}
    assert got["x", 0] == 10 and got["x", 1] == 22.5 and got["x", 3] == 30 and got["y", 0] == 5


def test_matching_is_one_to_one_and_nearest_first(spark):
    b = spark.createDataFrame([("s", 1, 5.0, 5.0, 5.0), ("s", 2, 5.3, 5.5, 5.4), ("s", 3, 9.0, 9.0, 9.0)], "session_id string, boundary_index long, lo double, hi double, boundary_time double")
    c = spark.createDataFrame([("s", 1, 5.1), ("s", 2, 5.2), ("s", 3, 9.25), ("s", 4, 9.26), ("s", 5, 20.0)], "session_id string, cand_index long, time_s double")
    got = sorted((r.cand_index, r.boundary_index, r.error) for r in matching.match_candidates(c, b).collect())
    assert got == [(1, 1, pytest.approx(0.1)), (2, 2, pytest.approx(0.1)), (3, 3, pytest.approx(0.25))]


def test_annotation_errors(spark):
    rows = [("ok", 1, 1, "0", "1.5", 9.0), ("ok", 2, 2, "1.5", "3", 9.0), ("bad", 1, 1, "2", "1", 9.0), ("bad", 2, 3, "0.5", "10", 9.0), ("bad", 3, 3, "x", "4", 9.0)]
    df = spark.createDataFrame(rows, "session_id string, row_no long, rep_number long, start_time string, end_time string, max_time double")
    got = {r.session_id: r for r in matching.annotation_errors(df).collect()}
    assert got["ok"].n_errors == 0 and got["ok"].rows_kept == 2
    assert got["bad"].errors == "row 1: start not before end; row 2: number out of order; row 2: outside the recording; row 2: overlaps the one before; row 3: time is no number"


def test_groups_split_whole(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(50)], "i long, g long")
    for split in (matching.split_groups(df, "g"), matching.hash_split(df, "g")):
        assert matching.leaks(split, "g").count() == 0
    assert matching.split_groups(df, "g").filter("part = 'test'").select("g").distinct().count() == 1
    with pytest.raises(ValueError):
        matching.split_groups(df.filter("g = 1"), "g")
