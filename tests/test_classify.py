"""Classifiers of candidate boundaries."""

import random

import pytest

from tidewater.plans import classify


@pytest.fixture(scope="module")
def candidates(spark):
    rng, rows = random.Random(2), []
    for i in range(240):
        good = rng.random() < 0.5
        rows.append([f"s{i % 12}", f"p{i % 6}", "accepted" if good or rng.random() < 0.3 else "rejected", "true_boundary" if good else "false_boundary", *[str(round(rng.gauss(1.5 if good else 0, 1), 4)) for _ in classify.FEATURES]])
    return spark.createDataFrame(rows, ["session_id", "participant_id", "hybrid_status", "human_label", *classify.FEATURES])


@pytest.mark.parametrize("kind", ["logistic", "boosting"])
def test_experiment(candidates, kind):
    out = classify.experiment(candidates, kind, balanced=kind == "logistic")
    by = {r.by: r for r in out["metrics"].collect()}
    assert by["model"].accuracy > 0.85 and by["rule"].recall == 1.0
    assert out["ranking"].collect()[0].roc_auc > 0.9
    assert all(r.absolute_error == abs(r.true_count - r.predicted_count) for r in out["counts"].collect())


def test_features_and_labels_stay_apart(candidates):
    with pytest.raises(ValueError):
        classify.check_features(("side",))
    with pytest.raises(ValueError):
        classify.numeric_rows(candidates.drop("plateau_support"))
    with pytest.raises(Exception, match="has no number"):
        classify.numeric_rows(candidates.selectExpr("* except (valley_depth)", "human_label as valley_depth")).select("valley_depth").collect()


def test_numbers_are_not_read_as_text(candidates):
    numbers = candidates.selectExpr("* except (valley_depth)", "try_cast(valley_depth as double) as valley_depth")
    plan = lambda df: classify.numeric_rows(df, ("valley_depth",)).select("valley_depth")._jdf.queryExecution().optimizedPlan().toString()
    assert "trim" in plan(candidates) and "trim" not in plan(numbers)
    with pytest.raises(Exception, match="has no number"):
        classify.numeric_rows(numbers.selectExpr("* except (valley_depth)", "cast(null as double) as valley_depth"), ("valley_depth",)).select("valley_depth").collect()
