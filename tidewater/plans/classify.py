"""Candidate boundaries: features, classifiers and experiments that can't leak."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching
from . import logistic

#: Fixed: the features a classifier may see, and the columns it never may.
FEATURES = (
    "valley_depth", "normalized_valley_depth", "rebound_strength", "valley_duration", "adjacent_contraction_center_gap", "left_segment_duration",
    "right_segment_duration", "plateau_support", "high_activation_area", "local_cycle_duration_estimate", "candidate_score",
)
FORBIDDEN = (
    "session_id", "recording_filename", "participant_id", "exercise", "side", "weight", "candidate_timestamp", "hybrid_status", "human_label",
    "matched_human_boundary_timestamp", "matching_error", "matched_boundary_index", "annotation_confidence", "annotation_status", "actual_reps", "expected_reps", "recording_csv", "source_filename", "source_path",
)
#: Types whose values are doubles as they are; others are read as text.
NUMBERS = ("double", "bigint", "int", "smallint", "tinyint")


def check_features(names: tuple[str, ...]) -> None:
    if wrong := set(names) & set(FORBIDDEN):
        raise ValueError(f"not allowed as features: {sorted(wrong)}")
    if unknown := set(names) - set(FEATURES):
        raise ValueError(f"unknown features: {sorted(unknown)}")


def numeric_rows(candidates: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Features as doubles and ``label`` 1 for a true boundary; text that is no number, or none, raises when it is read."""
    check_features(names)
    missing = [c for c in names if c not in candidates.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    types = dict(candidates.dtypes)
    number = lambda c: F.col(c).cast("double") if types[c] in NUMBERS else F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast("double")
    values = {c: F.coalesce(number(c), F.raise_error(F.lit(f"{c} has no number"))) for c in names}
    return candidates.withColumns({**values, "label": (F.col("human_label") == "true_boundary").cast("double")})


def train_model(train: DataFrame, kind: str = "logistic", names: tuple[str, ...] = FEATURES, balanced: bool = False, seed: int = 42) -> PipelineModel | logistic.LogisticModel:
    """Logistic regression of features standardised by the training part, with an L2 penalty of strength 1, or gradient boosted trees."""
    if kind == "logistic":
        return logistic.fit(with_class_weight(train) if balanced else train, names, weight="class_weight" if balanced else None)
    if kind == "boosting":
        stages = [VectorAssembler(inputCols=list(names), outputCol="features_raw"), StandardScaler(withMean=True, withStd=True, inputCol="features_raw", outputCol="features")]
        return Pipeline(stages=[*stages, GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed)]).fit(train)
    raise ValueError(f"no classifier named {kind}")


def with_class_weight(rows: DataFrame) -> DataFrame:
    """``class_weight``: rows over twice the rows of the class, so that both weigh alike."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return rows.join(F.broadcast(counts.crossJoin(F.broadcast(total))), "label").withColumn("class_weight", F.col("_all") / (2 * F.col("_n"))).drop("_n", "_all")


def predict(model: PipelineModel | logistic.LogisticModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``rows`` with the model's ``score`` for a true boundary, and ``predicted`` from ``threshold`` on."""
    if isinstance(model, logistic.LogisticModel):
        return model.transform(rows).withColumn("predicted", F.col("score") >= threshold)
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("predicted", F.col("score") >= threshold).drop("features_raw", "features", "rawPrediction", "probability", "prediction")


def rule_baseline(rows: DataFrame) -> DataFrame:
    """The valley detector's own verdict as a prediction."""
    return rows.withColumn("predicted", F.col("hybrid_status") == "accepted")


def experiment(candidates: DataFrame, kind: str = "logistic", group: str = "participant_id", names: tuple[str, ...] = FEATURES, test_fraction: float = 0.2, seed: int = 42, balanced: bool = False) -> dict[str, DataFrame]:
    """Split by group, check for leaks, train, and score the model and the rule on the same test rows.

    Training reads its rows many times, so they are kept as numbers while it lasts
    (in memory or on the executors' disks; what is lost is computed again).
    """
    rows = matching.split_groups(numeric_rows(candidates, names).persist(), group, test_fraction, seed)
    if matching.leaks(rows, group).limit(1).count():
        raise ValueError("a group lies in both parts")
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    if train.select("label").distinct().count() < 2:
        raise ValueError("both classes are needed for training")
    model = train_model(train, kind, names, balanced, seed)
    scored, truth = predict(model, test), F.col("label") == 1
    both = scored.withColumn("by", F.lit("model")).select("by", "label", "predicted").unionByName(rule_baseline(test).withColumn("by", F.lit("rule")).select("by", "label", "predicted"))
    return {
        "scored": scored, "metrics": matching.confusion(both, truth, F.col("predicted"), "by"),
        "ranking": matching.ranking_scores(scored.withColumn("all", F.lit("all")), truth, F.col("score"), "all"),
        "counts": count_errors(scored),
    }


def count_errors(scored: DataFrame) -> DataFrame:
    """Per session the true and predicted number of boundaries and the error."""
    g = scored.groupBy("session_id").agg(F.count_if(F.col("label") == 1).cast("long").alias("true_count"), F.count_if(F.col("predicted")).cast("long").alias("predicted_count"))
    return g.withColumn("error", F.col("predicted_count") - F.col("true_count")).withColumn("absolute_error", F.abs("error"))


def count_error_summary(errors: DataFrame, *keys: str) -> DataFrame:
    """Over sessions: mean and median absolute error, the share of exact counts, and how many have too many or too few."""
    n = lambda c: F.count_if(c).cast("long")
    return errors.groupBy(*keys).agg(
        F.round(F.avg("absolute_error"), 6).alias("mean_absolute_error"), F.round(F.median("absolute_error"), 6).alias("median_absolute_error"),
        F.round(F.avg((F.col("error") == 0).cast("int")), 6).alias("exact_share"), n(F.col("error") > 0).alias("too_many"), n(F.col("error") < 0).alias("too_few"))
