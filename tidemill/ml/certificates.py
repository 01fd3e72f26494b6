"""What must hold for a fitted model if it was fitted as asked: conditions over its training rows, worked out by Spark.

Each function gives rows (condition, value). A model needn't be small enough for a closed form: at the optimum of a convex
loss the gradient is known, a leaf holds the mean of what its tree was given, and components share out the variance.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, found: dict[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in found.items()], "condition string, value double")


def _moments(df: DataFrame, column: str) -> tuple[list[float], list[float]]:
    """Mean and sample variance of each slot."""
    m = df.select(Summarizer.metrics("mean", "variance").summary(F.col(column)).alias("m")).first()["m"]
    return [float(x) for x in m["mean"]], [float(x) for x in m["variance"]]


def _slot_sums(df: DataFrame, column: str, weight: Column) -> list[float]:
    """Sum of a weight times each slot: one row for each slot comes back."""
    each = df.select(weight.alias("w"), F.posexplode(vector_to_array(column)).alias("j", "x"))
    return [r["s"] for r in each.groupBy("j").agg(F.sum(F.col("w") * F.col("x")).alias("s")).orderBy("j").collect()]


def linear_gradient(model: Model, df: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Ridge or plain least squares with an intercept: residuals sum to 0, and the mean of residual times slot is the
    penalty's slope, lambda / deviation of the label * variance of the slot * coefficient. As shares of the label's deviation."""
    made = model.transform(df).persist()
    try:
        n, y_sd, mean, gap = made.agg(F.count(F.lit(1)), F.stddev_pop(label), F.avg("prediction"), F.avg(F.col(label) - F.col("prediction"))).first()
        _, variance = _moments(made, features)
        sums = _slot_sums(made, features, F.col(label) - F.col("prediction"))
    finally:
        made.unpersist()
    strength = model.getOrDefault("regParam") / y_sd
    steep = [abs(s / n - strength * v * (n - 1) / n * b) / (y_sd * max(v, 1e-12) ** 0.5) for s, v, b in zip(sums, variance, model.coefficients, strict=True)]
    return _rows(df, {"rows": n, "mean_prediction": mean, "mean_residual": gap, "steepest_slope": max(steep)})


def poisson_gradient(model: Model, df: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Poisson regression with log link: residuals sum to 0, and sums of residual times slot are lambda times the
    coefficient times the sum of the means. As shares of the mean and the slot's deviation."""
    made = model.transform(df).persist()
    try:
        n, mean, gap = made.agg(F.count(F.lit(1)), F.avg("prediction"), F.avg(F.col(label) - F.col("prediction"))).first()
        _, variance = _moments(made, features)
        sums = _slot_sums(made, features, F.col(label) - F.col("prediction"))
    finally:
        made.unpersist()
    strength = model.getOrDefault("regParam")
    steep = [abs(s / (n * mean) - strength * b) / max(v, 1e-12) ** 0.5 for s, v, b in zip(sums, variance, model.coefficients, strict=True)]
    return _rows(df, {"rows": n, "mean_prediction": mean, "mean_residual": gap, "steepest_slope": max(steep)})


def hinge_bound(model: Model, df: DataFrame, label: str, features: str = "features") -> DataFrame:
    """Linear support vector machine: the penalised mean hinge loss is at most that of no model at all, which is 1, and no
    point is far below it: the loss is convex, so along the line to zero it falls by its slope at most."""
    sign = 2 * F.col(label) - 1
    made = model.transform(df).select(features, label, vector_to_array("rawPrediction")[1].alias("m")).persist()
    try:
        n, hinge, inside = made.agg(F.count(F.lit(1)), F.avg(F.greatest(F.lit(0.0), 1 - sign * F.col("m"))), F.avg(F.when(sign * F.col("m") < 1, -sign * F.col("m")).otherwise(0.0))).first()
        _, variance = _moments(made, features)
    finally:
        made.unpersist()
    penalty = model.getOrDefault("regParam") * sum(v * b * b for v, b in zip(variance, model.coefficients, strict=True))
    # d/dt of the loss of t times the model, at t = 1: zero at an optimum; a share of the loss without a model.
    return _rows(df, {"rows": n, "better_than_none": float(hinge + penalty / 2 <= 1.0), "slope_to_zero": abs(inside + penalty)})


def component_shares(model: Model, df: DataFrame, column: str, out: str) -> DataFrame:
    """Principal components: unit vectors, orthogonal; the variance of each over the rows is its share of the whole."""
    _, before = _moments(df, column)
    _, after = _moments(model.transform(df).select(out), out)
    shares, p = [float(x) for x in model.explainedVariance.toArray()], model.pc.toArray()
    off = np.abs(p.T @ p - np.eye(p.shape[1])).max()
    gap = max(abs(a / sum(before) - s) for a, s in zip(after, shares, strict=True))
    return _rows(df, {"whole_variance": sum(before), "not_orthonormal": off, "share_gap": gap, "falling": float(shares == sorted(shares, reverse=True))})


def _trees(model: Model, df: DataFrame, features: str) -> tuple[DataFrame, list[str]]:
    """What each tree says of each row, one column a tree, and the leaves."""
    names = []
    for k, tree in enumerate(model.trees):
        names.append(f"__t{k}")
        tree.setFeaturesCol(features)
        df = tree.setPredictionCol(names[-1]).transform(df).drop("rawPrediction", "probability")
    return df, names


def forest_leaves(model: Model, df: DataFrame, label: str, features: str = "features", classes: bool = False) -> DataFrame:
    """A forest without bootstrap: each leaf of each tree holds the mean label of its rows (or the commonest class), and the
    leaves of a tree all rows."""
    leaves = model.setLeafCol("__leaf").transform(df)
    said, names = _trees(model, leaves.select(features, label, vector_to_array("__leaf").alias("__leaf"), F.col("prediction").alias("__all")), features)
    each = F.posexplode(F.arrays_zip("__leaf", F.array(*names).alias("__said")))
    by = said.select(F.col(label).alias("y"), each.alias("tree", "e")).groupBy("tree", F.col("e.__leaf").alias("leaf"))
    wrong = F.abs(F.avg("y") - F.first("e.__said")) if not classes else F.when(F.abs(F.avg("y") - 0.5) > 1e-9, F.abs((F.avg("y") > 0.5).cast("double") - F.first("e.__said"))).otherwise(0.0)
    gaps = by.agg(F.count(F.lit(1)).alias("n"), wrong.alias("gap")).groupBy("tree").agg(F.sum("n").alias("n"), F.max("gap").alias("gap")).agg(F.min("n"), F.max("n"), F.max("gap"), F.count(F.lit(1))).first()
    found = {"fewest_rows": gaps[0], "most_rows": gaps[1], "leaf_gap": gaps[2], "trees": gaps[3]}
    return _rows(df, found if classes else found | {"mean_prediction": said.agg(F.avg("__all")).first()[0]})


def boosted_leaves(model: Model, df: DataFrame, label: str, features: str = "features", classes: bool = False) -> DataFrame:
    """Boosted trees: each leaf of each round holds the mean over its rows of what the rounds before have left, the
    falling slope of the loss: squared error, or logistic loss on labels -1 and 1. The first round has the label itself."""
    leaves = model.setLeafCol("__leaf").transform(df)
    said, names = _trees(model, leaves.select(features, label, vector_to_array("__leaf").alias("__leaf")), features)
    y = F.col(label).cast("double") * 2 - 1 if classes else F.col(label).cast("double")
    upto, targets = F.lit(0.0), []
    for k, (name, weight) in enumerate(zip(names, model.treeWeights, strict=True)):
        targets.append((y if k == 0 else 4 * y / (1 + F.exp(2 * y * F.col(f"__f{k}"))) if classes else 2 * (y - F.col(f"__f{k}"))).alias(f"__y{k}"))
        upto = (F.col(f"__f{k}") if k else F.lit(0.0)) + F.lit(float(weight)) * F.col(name)
        said = said.withColumn(f"__f{k + 1}", upto)
    each = F.posexplode(F.arrays_zip("__leaf", F.array(*names).alias("__said"), F.array(*targets).alias("__y")))
    by = said.select(each.alias("round", "e")).groupBy("round", F.col("e.__leaf").alias("leaf"))
    per = by.agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("e.__y") - F.first("e.__said")).alias("gap"))
    gaps = per.groupBy("round").agg(F.sum("n").alias("n"), F.max("gap").alias("gap")).agg(F.min("n"), F.max("n"), F.max("gap"), F.count(F.lit(1))).first()
    return _rows(df, {"fewest_rows": gaps[0], "most_rows": gaps[1], "leaf_gap": gaps[2], "rounds": gaps[3]})
