"""The expanding baseline is the mean of the lowest tenth of the values so far."""

import random

from tidewater.operators import metrics


def levels(values):
    """As the method is stated: everything is sorted again at every reading."""
    n = len(values)
    if n < 30:
        return sum(values) / n + 18, sum(values) / n + 12
    lowest = sorted(values)[: max(1, n // 10)]
    base = sum(lowest) / len(lowest)
    return base + max(18, 0.12 * (max(values) - base)), base + max(12, 0.075 * (max(values) - base))


def recordings():
    rng = random.Random(3)
    return {
        "noisy": [round(rng.gauss(200, 60), 3) for _ in range(400)], "falling": [1000.0 - i for i in range(120)], "flat": [7.0] * 50,
        "short": [1.0, 5.0], "steps": [float(300 * (i // 20 % 2) - 40) for i in range(205)],
    }


def test_expanding_baseline(spark):
    made = recordings()
    rows = [(k, i, v) for k, values in made.items() for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    got = metrics.expanding_baseline(spark.createDataFrame(rows, "recording_id string, seq long, raw double").repartition(7)).collect()
    assert len(got) == len(rows)
    for r in got:
        enter, leave = levels(made[r.recording_id][: r.seq + 1])
        assert abs(r.enter - enter) < 1e-6 and abs(r.leave - leave) < 1e-6


def test_rows_without_a_value_keep_the_levels(spark):
    rows = [("a", 0, None, "x"), ("a", 1, 10.0, "x"), ("a", 2, None, "x"), (None, 0, 2.0, "x")]
    got = metrics.expanding_baseline(spark.createDataFrame(rows, "recording_id string, seq long, raw double, enter string"))
    assert {(r.recording_id, r.seq): (r.enter, r.leave) for r in got.collect()} == {("a", 0): (None, None), ("a", 1): (28.0, 22.0), ("a", 2): (28.0, 22.0), (None, 0): (20.0, 14.0)}
    assert metrics.expanding_baseline(spark.createDataFrame([], "recording_id string, seq long, raw double")).count() == 0
