"""Logistic regression with an L2 penalty by Newton's method; every step is one aggregation of the training rows.

A step needs the gradient and the Gram matrix of the features under the present
weights: (d + 1)(d + 4) / 2 sums, which Spark adds up on the executors.  Only they
reach the driver, which solves a system of d + 1 equations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class LogisticModel:
    """Means and population deviations of the training features, and the weights of the standardised ones."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def standardised(self) -> list[Column]:
        return [(F.col(c) - m) / d for c, m, d in zip(self.names, self.means, self.deviations)]

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for w, x in zip(self.weights, self.standardised()):
            z = z + w * x
        return 1 / (1 + F.exp(-z))

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", self.probability())

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.names, self.weights))


def fit(train: DataFrame, names: tuple[str, ...], label: str = "label", weight: str | None = None, strength: float = 1.0, steps: int = 50, tolerance: float = 1e-10) -> LogisticModel:
    """The model that minimises the weighted log loss plus ``|w|^2 / (2 strength)``; the intercept is free.

    A feature that never varies is left as it is.  Rows of both classes are needed.
    """
    stats = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)], F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    if stats["lo"] is None or stats["lo"] == stats["hi"]:
        raise ValueError("both classes are needed for training")
    d = len(names)
    model = LogisticModel(names, tuple(stats[f"m{i}"] for i in range(d)), tuple(stats[f"s{i}"] or 1.0 for i in range(d)), (0.0,) * d, 0.0)
    penalty = np.diag([1.0 / strength] * d + [0.0])
    w, of_row = np.zeros(d + 1), F.col(weight) if weight else F.lit(1.0)
    xs = [f"_x{i}" for i in range(d + 1)]
    base = train.select(F.col(label).alias("_y"), of_row.alias("_w"), *[x.alias(n) for x, n in zip([*model.standardised(), F.lit(1.0)], xs)])
    for _ in range(steps):
        z = sum((float(a) * F.col(x) for a, x in zip(w, xs)), F.lit(0.0))
        rows = base.withColumn("_p", 1 / (1 + F.exp(-z))).withColumns({"_g": F.col("_w") * (F.col("_y") - F.col("_p")), "_h": F.col("_w") * F.col("_p") * (1 - F.col("_p"))})
        sums = rows.agg(*[F.sum(F.col("_g") * F.col(x)) for x in xs], *[F.sum(F.col("_h") * F.col(xs[i]) * F.col(xs[j])) for i in range(d + 1) for j in range(i + 1)]).first()
        gradient, gram = np.array(sums[: d + 1]) - penalty @ w, np.zeros((d + 1, d + 1))
        at = d + 1
        for i in range(d + 1):
            for j in range(i + 1):
                gram[i, j] = gram[j, i] = sums[at]
                at += 1
        step = np.linalg.solve(gram + penalty, gradient)
        w = w + step
        if np.abs(step).max() < tolerance:
            break
    model.weights, model.intercept = tuple(map(float, w[:-1])), float(w[-1])
    return model
