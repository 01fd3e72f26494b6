"""All seven models, and the decomposition, on the feature chain at their full settings, against conditions that SQL knows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.ml import certificates
from tidemill.ml.specs import default_specs
from tidemill.operators import split
from tidemill.plans.queries import _TRAIN, _small_chain, _training, query

#: Values are compared after rounding to so many digits.
DIGITS = 4


def _learned(spark, sf: str, label: str, stages: list | None = None) -> DataFrame:
    """Training rows with the chain's vector, all of whose stages have learned from these rows."""
    train = split.train_test_split(_training(spark, sf), "event_id")[0]
    return Pipeline(stages=stages or _small_chain(label, False)).fit(train).transform(train).withColumn("shifted", F.col("delay") + F.lit(_shift(train)))


def _shift(train: DataFrame) -> float:
    from tidemill.ml.tournament import label_shift

    return label_shift(train, "delay")


def _est(name: str, label: str, **more):
    """The estimator of a specification, with some parameters set."""
    est = next(s for s in default_specs() if s.name == name).estimator().setLabelCol(label)
    return est.copy({est.getParam(k): v for k, v in more.items()})


def _certified(spark, sf: str, label: str, est, check: Callable[..., DataFrame], **more) -> DataFrame:
    rows = _learned(spark, sf, label if label != "shifted" else "delay").select("features", label).persist()
    try:
        found = check(est.fit(rows), rows, label, **more)
    finally:
        rows.unpersist()
    return found.select("condition", F.round("value", DIGITS).alias("value"))


def _known(**values: str) -> str:
    return f"WITH {_TRAIN}, l AS (SELECT *, (SELECT abs(least(min(delay), 0)) + 1 FROM t WHERE learn) AS shift FROM t WHERE learn) " + " UNION ALL ".join(f"SELECT '{k}' AS condition, round(CAST({v} AS DOUBLE), {DIGITS}) AS value FROM l" for k, v in values.items())


_N, _ZERO = "count(*)", "0 * count(*)"


@query(_known(rows=_N, mean_prediction="avg(delay)", mean_residual=_ZERO, steepest_slope=_ZERO))
def chain_linear_fit(spark, sf):
    return _certified(spark, sf, "delay", _est("linear_regression", "delay", regParam=0.01), certificates.linear_gradient)


@query(_known(rows=_N, mean_prediction="avg(delay + shift)", mean_residual=_ZERO, steepest_slope=_ZERO))
def chain_glm_fit(spark, sf):
    return _certified(spark, sf, "shifted", _est("glm_poisson_log", "shifted", regParam=0.1), certificates.poisson_gradient)


@query(_known(rows=_N, better_than_none="1 + 0 * count(*)", near_optimum="1 + 0 * count(*)"))
def chain_svc_fit(spark, sf):
    """Thirty steps come near the optimum and don't reach it: the slope along the model is under a hundredth."""
    found = _certified(spark, sf, "severe", _est("linear_svc", "severe", regParam=0.01), certificates.hinge_bound)
    near = F.col("condition") == "slope_to_zero"
    return found.select(F.when(near, "near_optimum").otherwise(F.col("condition")).alias("condition"), F.when(near, (F.col("value") < 0.01).cast("double")).otherwise(F.col("value")).alias("value"))


_FOREST = {"fewest_rows": _N, "most_rows": _N, "leaf_gap": _ZERO, "trees": "40 + 0 * count(*)"}


@query(_known(**_FOREST, mean_prediction="avg(delay)"))
def chain_rf_fit(spark, sf):
    """Forty trees eight deep, each of a third of the slots at every split; all rows for each tree, so that leaves are known."""
    return _certified(spark, sf, "delay", _est("random_forest_regressor", "delay", bootstrap=False), certificates.forest_leaves)


@query(_known(**_FOREST))
def chain_rf_classifier_fit(spark, sf):
    return _certified(spark, sf, "severe", _est("random_forest_classifier", "severe", bootstrap=False), certificates.forest_leaves, classes=True)


_ROUNDS = {"fewest_rows": _N, "most_rows": _N, "leaf_gap": _ZERO, "rounds": "40 + 0 * count(*)"}


@query(_known(**_ROUNDS))
def chain_gbt_fit(spark, sf):
    return _certified(spark, sf, "delay", _est("gbt_regressor", "delay"), certificates.boosted_leaves)


@query(_known(**_ROUNDS))
def chain_gbt_classifier_fit(spark, sf):
    return _certified(spark, sf, "severe", _est("gbt_classifier", "severe"), certificates.boosted_leaves, classes=True)


@query(_known(whole_variance="4 + count(DISTINCT dow)", not_orthonormal=_ZERO, share_gap=_ZERO, falling="1 + 0 * count(*)"))
def chain_pca(spark, sf):
    """The chain's slots have unit variance: the two numbers, the two means, and a slot for each weekday."""
    rows = _learned(spark, sf, "delay").select("picked").persist()
    try:
        found = certificates.component_shares(PCA(k=5, inputCol="picked", outputCol="pc").fit(rows), rows, "picked", "pc")
    finally:
        rows.unpersist()
    return found.select("condition", F.round("value", DIGITS).alias("value"))


_ARMS = " UNION ALL ".join(f"SELECT '{s.name}__{a}' AS arm, '{s.task}' AS task" for s in default_specs() for a in ("pca", "nopca"))


@query(f"WITH {_TRAIN} SELECT arm, task, true AS chosen_from_grid, true AS within_bounds, count(*) FILTER (NOT learn) AS scored FROM ({_ARMS}) CROSS JOIN t GROUP BY ALL")
def tournament_all(spark, sf):
    """All seven models on both arms: grid, folds, refit, metrics, run and model of each. Trees and rounds are few here, so
    that fourteen arms take a minute or two; the chain queries have each model at its full settings."""
    from dataclasses import replace

    from tidemill.ml.features import FeatureSpec
    from tidemill.ml.tournament import Settings, run_tournament
    from tidemill.ml.tracking import Tracker
    from tidemill.sources.store import work_folder

    few = {"numTrees": 2, "maxIter": 2, "maxDepth": 3}

    def light(spec):
        def build(make=spec.build):
            est = make()
            return est.copy({est.getParam(k): v for k, v in few.items() if est.hasParam(k)})

        first, *_ = spec.grid  # two points of the first parameter
        return replace(spec, build=build, grid=((first[0], (3, 4) if first[0] == "maxDepth" else first[1]),))

    rows = _training(spark, sf).withColumns({"label_delay": F.col("delay"), "label_severe": F.col("severe")})
    features = FeatureSpec(
        clipped=("value",), clipped_to=("value_clip",), logged=("user_id",), logged_to=("user_log",), imputed=(), encoded=("place", "airline"), encoded_to=("te_place", "te_airline"),
        indexed=("airline",), indexed_to=("airline_idx",), one_hot=("airline_idx", "dow"), plain=("value",), geo_from=(), geo_to=(),
    )
    tracker = Tracker(spark, work_folder(spark, "tournament-all"))
    out = run_tournament(rows, [light(s) for s in default_specs()], tracker, Settings("event_id", folds=2, pca_k=3, tune_per_mille=300, features=features), resume=False)
    if out.failures:
        raise RuntimeError(str(out.failures))
    test = split.train_test_split(rows, "event_id")[1].withColumn("label_glm", F.col("delay") + F.lit(out.offset))
    found = []
    for name, r in sorted(out.results.items()):
        m = r["metrics"]
        ok = m["rmse"] > 0 and m["mae"] <= m["rmse"] and m["r2"] < 1 if r["task"] == "regression" else all(0 <= m[k] <= 1 for k in m)
        made = out.models[name].transform(test).agg(F.count("prediction").alias("n")).first()["n"]
        found.append((name, r["task"], any(k.startswith("best_") for k in r), bool(ok), made))
    return spark.createDataFrame(found, "arm string, task string, chosen_from_grid boolean, within_bounds boolean, scored long")


@query(f"WITH {_TRAIN} SELECT count(*) AS scored, CAST(0 AS BIGINT) AS different, count(*) FILTER (learn) AS learned FROM t")
def stream_chain_score(spark, sf):
    """The chain with its encoder, one-hot and scaler, and a model, on a stream of JSON events: rows, and how many of them
    have another prediction than in one batch."""
    from tidemill.plans.contract import ServingContract
    from tidemill.sources.store import work_folder
    from tidemill.streaming.score import drain, start_scoring

    work = work_folder(spark, "chain-stream")
    rows = _training(spark, sf)
    train, test = split.train_test_split(rows, "event_id")
    model = Pipeline(stages=[*_small_chain("delay", False), _est("linear_regression", "delay", regParam=0.01)]).fit(train)
    rows.drop("delay", "severe").coalesce(3).write.json(f"{work}/in")
    contract = ServingContract.of(rows, ("delay", "severe"))
    drain(start_scoring(spark, f"{work}/in", contract, model, f"{work}/out", f"{work}/checkpoint", keep=("event_id",)))
    streamed = spark.read.parquet(f"{work}/out").select("event_id", F.col("prediction").alias("p"))
    both = model.transform(rows.drop("delay", "severe")).select("event_id", "prediction").join(streamed, "event_id", "left")
    off = F.coalesce(F.abs(F.col("p") - F.col("prediction")) > 1e-9, F.lit(True))
    return both.agg(F.count("p").alias("scored"), F.sum(off.cast("long")).alias("different"), F.lit(train.count()).alias("learned"))
