"""Model specifications: estimators, grids and evaluators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder


@dataclass(frozen=True)
class ModelSpec:
    name: str
    task: str  # "regression" or "classification"
    label: str
    build: Callable[[], Estimator]
    grid: tuple[tuple[str, tuple], ...] = ()

    def estimator(self) -> Estimator:
        return self.build().setFeaturesCol("features").setLabelCol(self.label)

    def param_maps(self, est: Estimator) -> list[dict]:
        b = ParamGridBuilder()
        for name, values in self.grid:
            b = b.addGrid(est.getParam(name), list(values))
        return b.build()


#: Settings of the seven models and their grids.
TREES = {"maxBins": 64, "seed": 7}


def default_specs(delay: str = "label_delay", severe: str = "label_severe", shifted: str = "label_glm") -> list[ModelSpec]:
    return [
        ModelSpec("linear_regression", "regression", delay, lambda: LinearRegression(maxIter=50), (("regParam", (0.01, 0.1)), ("elasticNetParam", (0.0, 0.5)))),
        ModelSpec("glm_poisson_log", "regression", shifted, lambda: GeneralizedLinearRegression(family="poisson", link="log", maxIter=25), (("regParam", (0.1, 1.0)),)),
        ModelSpec("linear_svc", "classification", severe, lambda: LinearSVC(maxIter=30), (("regParam", (0.01, 0.1)),)),
        ModelSpec("random_forest_regressor", "regression", delay, lambda: RandomForestRegressor(numTrees=40, maxDepth=8, **TREES), (("maxDepth", (6, 10)), ("numTrees", (40, 80)))),
        ModelSpec("random_forest_classifier", "classification", severe, lambda: RandomForestClassifier(numTrees=40, maxDepth=8, **TREES), (("maxDepth", (6, 10)), ("numTrees", (40, 80)))),
        ModelSpec("gbt_regressor", "regression", delay, lambda: GBTRegressor(maxIter=40, maxDepth=5, **TREES), (("maxDepth", (4, 6)), ("maxBins", (32, 64)))),
        ModelSpec("gbt_classifier", "classification", severe, lambda: GBTClassifier(maxIter=40, maxDepth=5, **TREES), (("maxDepth", (4, 6)),)),
    ]


def evaluators(task: str, label: str) -> dict[str, Evaluator]:
    """By metric name; the first is the one that tuning goes by."""
    if task == "regression":
        return {m: RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=m) for m in ("rmse", "mae", "r2")}
    two = {m: BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName=m) for m in ("areaUnderROC", "areaUnderPR")}
    return two | {m: MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName=m) for m in ("f1", "accuracy")}
