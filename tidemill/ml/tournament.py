"""The tournament: every model on every arm, cross-validated, resumable, one failure not stopping the rest."""

from __future__ import annotations

import json
import time
import traceback
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.ml.features import FeatureSpec, feature_names, feature_stages, importances
from tidemill.ml.specs import ModelSpec, evaluators
from tidemill.ml.measured import Cost, measured
from tidemill.ml.search import cross_validate, fit_best
from tidemill.ml.stages import FitCache
from tidemill.ml.tracking import Tracker
from tidemill.operators.split import hash_sample, train_test_split, with_folds
from tidemill.sources.sinks import put_json

ARMS = {"pca": True, "nopca": False}


def label_shift(df: DataFrame, label: str) -> float:
    """What makes every label of these rows positive: |min(least label, 0)| + 1."""
    least = df.agg(F.min(label)).first()[0]
    return abs(min(float(least or 0.0), 0.0)) + 1.0


@dataclass
class Settings:
    key: str
    folds: int = 5
    parallelism: int = 4
    pca_k: int = 10
    tune_per_mille: int = 20
    train_percent: int = 80
    label: str = "label_delay"
    shifted: str = "label_glm"
    features: FeatureSpec = field(default_factory=FeatureSpec)
    results_path: str | None = None
    fail_fast: bool = False


@dataclass
class Outcome:
    results: dict[str, dict]
    failures: dict[str, str]
    models: dict[str, PipelineModel]
    offset: float


def best_index(scores: Sequence[float], larger: bool) -> int:
    """The first of the best scores."""
    return max(range(len(scores)), key=lambda i: (scores[i] if larger else -scores[i], -i))


def checkpoint(path: str | None, results: dict, failures: dict) -> None:
    """Writes what is known so far; a failure to write never stops the tournament."""
    if path is None:
        return
    try:
        put_json(path, {"results": results, "failures": failures})
    except Exception:  # whatever the store says
        traceback.print_exc()


def run_arm(spec: ModelSpec, use_pca: bool, train: DataFrame, tune: DataFrame, test: DataFrame, s: Settings) -> tuple[PipelineModel, dict[str, float], dict]:
    est, scores = spec.estimator(), evaluators(spec.task, spec.label)
    primary = next(iter(scores.values()))
    grid = spec.param_maps(est)
    chain = lambda held: feature_stages(spec.label, use_pca, s.pca_k, s.features, held)
    averages = cross_validate(chain, est, grid, with_folds(tune, s.key, s.folds, "__fold"), "__fold", s.folds, primary, s.parallelism)
    at = best_index(averages, primary.isLargerBetter())
    best = {p.name: v for p, v in grid[at].items()}
    # The choice was made on a part of the rows; the model is fitted to all of them.
    model = fit_best(chain, est, grid[at], train)
    made = model.transform(test)
    predicted = made.select(*(c for c in (spec.label, "prediction", "rawPrediction") if c in made.columns)).persist()
    try:
        metrics = {name: float(e.evaluate(predicted)) for name, e in scores.items()}
    finally:
        predicted.unpersist()
    extra = {f"best_{k}": v for k, v in best.items()} | {"cv_best": float(averages[at])}
    extra |= {f"param_{p.name}": v for p, v in model.stages[-1].extractParamMap().items() if isinstance(v, (bool, int, float, str))}
    extra |= {"folds": s.folds, "tune_per_mille": s.tune_per_mille, "train_percent": s.train_percent, "pca_k": s.pca_k if use_pca else None, "features": json.dumps(asdict(s.features))}
    pca = next((m for m in model.stages if type(m).__name__ == "PCAModel"), None)
    if pca is not None:
        shares = [float(x) for x in pca.explainedVariance.toArray()]
        extra |= {"pca_variance_retained": sum(shares), "pca_variance": json.dumps(shares)}
    return model, metrics, extra


def run_tournament(curated: DataFrame, specs: Sequence[ModelSpec], tracker: Tracker, s: Settings, arms: Sequence[str] = tuple(ARMS), resume: bool = True) -> Outcome:
    """Every arm is named model__arm. Arms that the tracker has as finished aren't run again."""
    train, test = train_test_split(curated, s.key, s.train_percent)
    offset = label_shift(train, s.label)
    train, test = (d.withColumn(s.shifted, F.col(s.label) + F.lit(offset)) for d in (train, test))
    train, test = train.persist(), test.persist()
    tune = train if s.tune_per_mille >= 1000 else hash_sample(train, s.key, s.tune_per_mille).persist()
    out = Outcome({}, {}, {}, offset)
    done = tracker.completed() if resume else {}
    try:
        for spec in specs:
            for arm in arms:
                name = f"{spec.name}__{arm}"
                if name in done:
                    out.results[name] = {"task": spec.task, "model": spec.name, "arm": arm, "metrics": done[name], "resumed": True}
                    continue
                began = time.time()
                try:
                    model, metrics, extra = run_arm(spec, ARMS[arm], train, tune, test, s)
                    # The model first: a run that counts as finished has one, whatever happens to this process.
                    run = tracker.log_run(name, spec.task, metrics, extra, started=began, tags={"model_uri": tracker.save_model(model)})
                    tracker.log_artifact(run, "importances.json", importances(model, feature_names(model, test)))
                    out.models[name] = model
                    out.results[name] = {"task": spec.task, "model": spec.name, "arm": arm, "metrics": metrics, "train_seconds": time.time() - began, **extra}
                except Exception as e:
                    tracker.log_run(name, spec.task, {}, {"error": str(e)[:500]}, status="FAILED", started=began)
                    out.failures[name] = f"{type(e).__name__}: {e}"[:500]
                    if s.fail_fast:
                        raise
                finally:
                    checkpoint(s.results_path, out.results, out.failures)
    finally:
        for d in (train, test, tune):
            d.unpersist()
    return out


def winner(results: dict[str, dict], metric: str = "rmse", task: str = "regression") -> str:
    """The arm of the task with the least metric; ties go to the first name."""
    fit = {n: r["metrics"][metric] for n, r in results.items() if r["task"] == task and metric in r["metrics"]}
    if not fit:
        raise LookupError(f"no finished {task} arm has {metric}")
    return min(fit, key=lambda n: (fit[n], n))


def register_winner(outcome: Outcome, tracker: Tracker, model: str = "best_pipeline", aliases: Sequence[str] = ("staging", "production")) -> int:
    """Registers the best regression arm and moves the aliases to it, in order. A resumed winner keeps its version;
    one that finished before it could be registered is registered with the model of its run."""
    name = winner(outcome.results)
    row = None if name in outcome.models else tracker.versions().where((F.col("model") == model) & (F.col("run_name") == name)).orderBy(F.desc("version")).first()
    if row is not None:
        version = row["version"]
    else:
        fitted = outcome.models.get(name) or tracker.run_model(name)
        tags = {"rmse": outcome.results[name]["metrics"]["rmse"], "glm_offset": outcome.offset, "arms": len(outcome.results)}
        version = tracker.register(model, name, fitted, tags)
    for a in aliases:
        tracker.set_alias(model, a, version)
    return version


def profile_stages(stages: Sequence, df: DataFrame) -> list[tuple[str, Cost, Cost]]:
    """(stage, cost of the fit, cost of the transform) of a chain, each stage on what those before it made; then the whole
    fitted chain in one go, under the name "pipeline"."""
    spark, out, models, first = df.sparkSession, [], [], df
    for s in stages:
        with measured(spark) as fit:
            model = s.fit(df) if hasattr(s, "fit") else s
        with measured(spark) as transform:
            df = model.transform(df)
            df.write.format("noop").mode("overwrite").save()
        out.append((type(s).__name__, fit, transform))
        models.append(model)
    for s in stages:
        if isinstance(s, FitCache):
            s.held.release()
    with measured(spark) as whole:
        PipelineModel(models).transform(first).write.format("noop").mode("overwrite").save()
    return [*out, ("pipeline", sum((r[1] for r in out), Cost()), whole)]
