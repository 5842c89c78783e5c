"""From samples to labelled candidates and an experiment; the regression against numpy."""

import numpy as np
import pytest

from tidewater.plans import classify, dataset, logistic
from tidewater.sources.sessions import CANDIDATE_COLUMNS

from .test_detect import bumps, frame


def test_candidates_are_labelled_by_their_boundary(spark):
    made = {"r1": [30.0] * 20 + bumps((900, 940, 980, 900), 320, 4.0) + [30.0] * 20, "r2": [30.0] * 20 + bumps((900, 900, 900), 320, 4.0) + [30.0] * 20, "other": [1.0] * 50}
    samples = frame(spark, made)
    sessions = spark.createDataFrame([("s1", "r1", "r1.csv", "p1", "curl", "left", "5", "0.8"), ("s2", "r2", "r2.csv", "p2", "curl", "right", "", None)], "session_id string, recording_id string, recording_filename string, participant_id string, exercise string, side string, weight string, confidence string")
    # the second session leaves out its last cut
    spans = [("s1", 1, 2.0, 6.0, "high"), ("s1", 2, 6.0, 10.0, "high"), ("s1", 3, 10.0, 14.0, ""), ("s1", 4, 14.0, 18.0, ""), ("s2", 1, 2.0, 6.0, ""), ("s2", 2, 6.0, 14.0, "")]
    intervals = spark.createDataFrame(spans, "session_id string, rep_number long, start_time double, end_time double, confidence string")
    rows = dataset.candidate_rows(samples, sessions, intervals, tolerance=0.4).collect()
    assert tuple(rows[0].asDict())[:24] == CANDIDATE_COLUMNS
    true = {s: sorted(r.matched_human_boundary_timestamp for r in rows if r.session_id == s and r.human_label == "true_boundary") for s in ("s1", "s2")}
    assert true == {"s1": [6.0, 10.0, 14.0], "s2": [6.0]}
    hits = {(r.session_id, r.matched_boundary_index): (r.annotation_confidence, r.participant_id) for r in rows if r.matched_boundary_index}
    # a valley that is looked at again in a smaller segment is one more candidate; the first of them takes the boundary
    assert hits == {("s1", 1): ("high", "p1"), ("s1", 2): ("high", "p1"), ("s1", 3): ("0.8", "p1"), ("s2", 1): ("", "p2")}
    assert all(r.annotation_confidence is None and r.matching_error is None for r in rows if r.human_label == "false_boundary")
    assert any(r.human_label == "false_boundary" and r.session_id == "s2" and abs(r.candidate_timestamp - 10) < 0.4 for r in rows)


@pytest.mark.parametrize("balanced", [False, True])
def test_regression_equals_numpy(spark, balanced):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) * [1, 50, 0.01] + [0, 7, 3]
    y = (x[:, 0] + (x[:, 1] - 7) / 50 + rng.normal(size=300) > 0.8).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, label double")
    model = classify.train_model(df, names=("a", "b", "c"), balanced=balanced)
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(300)]
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (1 - y).sum())) if balanced else np.ones(300)
    w = np.zeros(4)
    for _ in range(2000):  # plain gradient descent on the same loss
        p = 1 / (1 + np.exp(-z @ w))
        w -= 0.01 * (z.T @ (weight * (p - y)) + np.r_[w[:3], 0])
    assert np.allclose([*model.weights, model.intercept], w, atol=1e-6)
    scored = classify.predict(model, df).collect()
    assert np.allclose([r.score for r in scored], 1 / (1 + np.exp(-z @ w)), atol=1e-6) and all(r.predicted == (r.score >= 0.5) for r in scored)


def test_a_feature_that_never_varies_and_one_class(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i > 4)) for i in range(9)], "a double, b double, label double")
    model = logistic.fit(df, ("a", "b"))
    assert model.coefficients()["b"] == pytest.approx(0, abs=1e-9) and model.coefficients()["a"] > 0
    with pytest.raises(ValueError):
        logistic.fit(df.filter("label = 1"), ("a", "b"))


def test_eligible_sessions_and_the_rest(spark):
    df = spark.createDataFrame([("s1", "p", "locked", True, 0, 3), ("s2", "p", "draft", True, 0, 3)], "session_id string, participant_id string, annotation_status string, has_csv boolean, n_errors long, n_reps long")
    good, skipped = dataset.eligible(df)
    assert [r.session_id for r in good.collect()] == ["s1"] and [(r.session_id, r.reason) for r in skipped.collect()] == [("s2", "annotations not locked")]
