"""Cross-validation in which the feature chain is fitted once for each fold, not once for each fold and grid point."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.ml.stages import HeldRows

#: Makes the stages before the model; what their fit keeps in memory belongs to the given HeldRows.
Chain = Callable[[HeldRows], list]


def fit_features(chain: Chain, train: DataFrame) -> PipelineModel:
    """The fitted chain; what its fit has kept is let go when it is done."""
    with HeldRows() as held:
        return Pipeline(stages=chain(held)).fit(train)


def vectors(features: PipelineModel, rows: DataFrame, label: str, column: str = "features") -> DataFrame:
    """What a model learns from: the vector and the label, kept until the caller lets go."""
    return features.transform(rows).select(column, label).persist(StorageLevel.MEMORY_AND_DISK)


def cross_validate(chain: Chain, est: Estimator, grid: Sequence[dict], rows: DataFrame, fold: str, folds: int, evaluator: Evaluator, parallelism: int = 1) -> list[float]:
    """The mean metric of each grid point over the folds, as a cross-validator over chain and model together would give.

    For each fold the chain learns from the other folds' rows, and all grid points from the vectors that it makes, up to
    parallelism of them at once. Two tables of vectors are held at a time, whatever the number of folds and points.
    """
    label, column = est.getOrDefault("labelCol"), est.getOrDefault("featuresCol")
    totals = [0.0] * len(grid)
    for k in range(folds):
        train, valid = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
        features = fit_features(chain, train)
        seen, unseen = (vectors(features, d, label, column) for d in (train, valid))

        def score(at: int, seen: DataFrame = seen, unseen: DataFrame = unseen) -> float:
            return float(evaluator.evaluate(est.copy(grid[at]).fit(seen).transform(unseen)))

        try:
            with ThreadPool(max(1, min(parallelism, len(grid)))) as pool:
                for at, value in enumerate(pool.map(score, range(len(grid)))):
                    totals[at] += value / folds
        finally:
            seen.unpersist()
            unseen.unpersist()
    return totals


def fit_best(chain: Chain, est: Estimator, params: dict, train: DataFrame) -> PipelineModel:
    """Chain and model fitted to all rows, as one model; the vectors are made once and let go."""
    features = fit_features(chain, train)
    seen = vectors(features, train, est.getOrDefault("labelCol"), est.getOrDefault("featuresCol"))
    try:
        model: Model = est.copy(params).fit(seen)
    finally:
        seen.unpersist()
    return PipelineModel([*features.stages, model])
