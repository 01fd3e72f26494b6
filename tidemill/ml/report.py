"""Result tables from runs."""

from __future__ import annotations

import io
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.sources.files import read_json
from tidemill.sources.store import put_bytes

METRICS = {"regression": ("rmse", "mae", "r2"), "classification": ("areaUnderROC", "areaUnderPR", "f1", "accuracy")}


def load_results(tracker=None, path: str | None = None) -> dict[str, dict]:
    """Finished runs of the tracker, else the results file."""
    if tracker is not None:
        from tidemill.ml.tracking import latest_finished

        rows = latest_finished(tracker.runs()).collect()
        if rows:
            return {r["name"]: {"task": r["task"], "model": r["name"].split("__")[0], "arm": r["name"].split("__")[1], "metrics": dict(r["metrics"]), "train_seconds": r["seconds"]} for r in rows}
    return read_json(path)["results"] if path else {}


def ranked(results: DataFrame) -> DataFrame:
    """Ranks (task, name, rmse, auc) within each task: least rmse, or largest area; without one, last."""
    key = F.when(F.col("task") == "regression", F.col("rmse")).otherwise(-F.col("auc"))
    w = Window.partitionBy("task").orderBy(key.asc_nulls_last(), "name")
    return results.withColumn("rank", F.row_number().over(w))


def arm_comparison(results: DataFrame, metric: str, arms: tuple[str, ...] = ("pca", "nopca")) -> DataFrame:
    """A row for each model, a column for each arm; null where there is no such run."""
    return results.groupBy("model").pivot("arm", list(arms)).agg(F.first(metric))


def markdown_table(results: dict[str, dict]) -> str:
    """Both tasks as Markdown, best first, four digits, a dash for what is missing."""
    out = []
    for task, names in METRICS.items():
        rows = [(n, r) for n, r in results.items() if r["task"] == task]
        if not rows:
            continue
        first, sign = names[0], 1 if task == "regression" else -1
        rows.sort(key=lambda x: (x[1]["metrics"].get(first) is None, sign * (x[1]["metrics"].get(first) or 0.0), x[0]))
        out += [f"## {task.capitalize()}", "", "| model | arm | " + " | ".join(names) + " | train s |", "|" + "---|" * (len(names) + 3)]
        for _, r in rows:
            cells = [f"{r['metrics'][m]:.4f}" if m in r["metrics"] else "-" for m in names]
            seconds = f"{r['train_seconds']:.0f}" if r.get("train_seconds") is not None else "-"
            out.append(f"| {r['model']} | {r['arm']} | " + " | ".join(cells) + f" | {seconds} |")
        out.append("")
    return "\n".join(out)


def importances_of(tracker) -> dict[str, list[tuple[str, float]]]:
    """By run name, the importances that the latest finished run logged, largest first."""
    from tidemill.ml.tracking import latest_finished

    out = {}
    for r in latest_finished(tracker.runs()).select("name", "run_id").collect():
        try:
            out[r["name"]] = [(n, float(v)) for n, v in tracker.read_artifact(r["run_id"], "importances.json")]
        except FileNotFoundError:
            continue
    return out


def variance_shares(tracker) -> dict[str, list[float]]:
    """By run name, the share of variance that each component of its decomposition has."""
    from tidemill.ml.tracking import latest_finished

    rows = latest_finished(tracker.runs()).select("name", F.try_element_at("params", F.lit("pca_variance")).alias("v")).where("v is not null").collect()
    return {r["name"]: json.loads(r["v"]) for r in rows}


def write_benchmark(tracker, out: str, predicted: DataFrame | None = None, label: str = "label_delay", top: int = 15) -> list[str]:
    """The result table, and the figures' numbers beside the figures themselves where matplotlib is there: comparison of
    arms, importances, cumulative variance, and residuals of predictions. The paths written, in any store."""
    from tidemill.operators.metrics import hexagons, quantiles, range_histogram
    from tidemill.sources.sinks import put_json
    from tidemill.sources.store import replace_text

    spark, results, paths = tracker.spark, load_results(tracker), [f"{out}/results_table.md"]
    replace_text(spark, paths[0], markdown_table(results))
    figures: dict[str, list[tuple[str, float]]] = {}
    for task, names in METRICS.items():
        figures[f"arms_{task}"] = sorted((n, r["metrics"][names[0]]) for n, r in results.items() if r["task"] == task and names[0] in r["metrics"])
    figures |= {f"importances_{n}": rows[:top] for n, rows in importances_of(tracker).items()}
    figures |= {f"variance_{n}": [(f"pc_{k + 1}", sum(v[: k + 1])) for k in range(len(v))] for n, v in variance_shares(tracker).items()}
    if predicted is not None:
        both = predicted.select(F.col(label).cast("double").alias("y"), F.col("prediction").alias("p")).where("y is not null and p is not null").persist()
        try:
            bins, low, high = range_histogram(both, F.col("y") - F.col("p"))
            rows = bins.orderBy("bin").collect()  # sixty at most
            bounds = quantiles(both, F.col("y"), (0.005, 0.995), between=True)
            cells = hexagons(both, F.col("y"), F.col("p"), *bounds).orderBy("lattice", "hx", "hy").collect() if None not in bounds and bounds[1] > bounds[0] else []
        finally:
            both.unpersist()
        width = (high - low) / 60
        figures["residuals"] = [(f"{low + width * r['bin']:g}", float(r["n"])) for r in rows]
        if cells:  # some thousand hexagons at most, whatever the number of rows
            shape = {"low": bounds[0], "high": bounds[1], "across": 45, "cells": [[r["cx"], r["cy"], r["n"]] for r in cells]}
            put_json(f"{out}/predicted_actual.json", shape)
            paths.append(f"{out}/predicted_actual.json")
            if plot_hexagons(shape, f"{out}/predicted_actual.png", "predicted against actual", spark):
                paths.append(f"{out}/predicted_actual.png")
    for name, rows in figures.items():
        if rows:
            put_json(f"{out}/{name}.json", rows)
            paths.append(f"{out}/{name}.json")
            draw = plot_line if name.startswith("variance_") else plot_bars
            if draw(rows, f"{out}/{name}.png", name.replace("_", " "), spark):
                paths.append(f"{out}/{name}.png")
    return paths


def _figure(size: tuple[float, float], title: str):
    """A figure and its axes if matplotlib is there."""
    try:
        from matplotlib.backends.backend_agg import FigureCanvasAgg
        from matplotlib.figure import Figure
    except ImportError:
        return None
    fig = Figure(figsize=size, layout="constrained")
    FigureCanvasAgg(fig)
    ax = fig.subplots()
    ax.set_title(title)
    return fig, ax


def _saved(fig, path: str, spark) -> bool:
    drawn = io.BytesIO()
    fig.savefig(drawn, dpi=150, format="png")
    put_bytes(spark or SparkSession.active(), path, drawn.getvalue())
    return True


def plot_hexagons(shape: dict, path: str, title: str, spark=None) -> bool:
    """Filled hexagons, darker for more rows, and the line on which prediction and actual agree; whether it was drawn."""
    made = _figure((6, 6), title)
    if made is None:
        return False
    from matplotlib.collections import PolyCollection

    fig, ax = made
    low, high, step = shape["low"], shape["high"], (shape["high"] - shape["low"]) / shape["across"]
    up = (high - low) / int(shape["across"] / 3**0.5) / 3
    corner = [(0, -up), (step / 2, -up / 2), (step / 2, up / 2), (0, up), (-step / 2, up / 2), (-step / 2, -up / 2)]
    drawn = PolyCollection([[(x + a, y + b) for a, b in corner] for x, y, _ in shape["cells"]], array=[n for _, _, n in shape["cells"]], cmap="Blues")
    ax.add_collection(drawn)
    ax.plot([low, high], [low, high], linestyle="--", color="black", linewidth=1)
    ax.set(xlim=(low, high), ylim=(low, high), xlabel="actual", ylabel="predicted")
    fig.colorbar(drawn, label="rows")
    return _saved(fig, path, spark)


def plot_line(rows: list[tuple[str, float]], path: str, title: str, spark=None) -> bool:
    """A curve through the values in order; whether it was drawn."""
    made = _figure((8, 4), title)
    if made is None:
        return False
    fig, ax = made
    ax.plot([r[0] for r in rows], [r[1] for r in rows], marker="o")
    ax.set_ylim(0, 1.02)
    return _saved(fig, path, spark)


def plot_bars(rows: list[tuple[str, float]], path: str, title: str, spark=None) -> bool:
    """A bar chart if matplotlib is there, in any store; whether it was drawn."""
    made = _figure((8, 0.35 * len(rows) + 1.5), title)
    if made is None:
        return False
    fig, ax = made
    ax.barh([r[0] for r in reversed(rows)], [r[1] for r in reversed(rows)])
    return _saved(fig, path, spark)
