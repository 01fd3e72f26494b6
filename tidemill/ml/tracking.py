"""Runs and a model registry as append-only JSON rows, read back as DataFrames."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.sources.store import exists, get_text, put_text

RUN_DDL = "run_id string, name string, task string, status string, started double, seconds double, params map<string,string>, metrics map<string,double>, tags map<string,string>"
VERSION_DDL = "model string, version int, run_name string, uri string, created double, tags map<string,string>"
ALIAS_DDL = "model string, alias string, version int, set_at double"


def latest_finished(runs: DataFrame) -> DataFrame:
    """The latest finished run with metrics of each name that is model__arm. Runs that failed half way don't count."""
    done = runs.where((F.col("status") == "FINISHED") & F.col("name").contains("__") & (F.size("metrics") > 0))
    w = Window.partitionBy("name").orderBy(F.desc("started"), F.desc("run_id"))
    return done.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


@dataclass
class Tracker:
    """A folder of runs, versions and aliases in any store. Each entry is a file of its own, put in place whole."""

    spark: SparkSession
    root: str

    def _put(self, kind: str, row: dict) -> None:
        at = row.get("set_at", row.get("created", row.get("started")))
        put_text(self.spark, f"{self.root}/{kind}/{at:.6f}-{uuid.uuid4().hex}.json", json.dumps(row, sort_keys=True))

    def _read(self, kind: str, ddl: str) -> DataFrame:
        folder = f"{self.root}/{kind}"
        if not exists(self.spark, folder):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).option("multiLine", True).json(folder)

    def log_run(self, name: str, task: str, metrics: dict[str, float], params: dict | None = None, status: str = "FINISHED", started: float | None = None, tags: dict | None = None) -> str:
        began = time.time() if started is None else started
        row = {"run_id": uuid.uuid4().hex, "name": name, "task": task, "status": status, "started": began, "seconds": max(0.0, time.time() - began)}
        row |= {"params": {k: str(v) for k, v in (params or {}).items()}, "metrics": {k: float(v) for k, v in metrics.items()}, "tags": {k: str(v) for k, v in (tags or {}).items()}}
        self._put("runs", row)
        return row["run_id"]

    def log_artifact(self, run_id: str, name: str, value: object) -> str:
        path = f"{self.root}/artifacts/{run_id}/{name}"
        put_text(self.spark, path, json.dumps(value))
        return path

    def read_artifact(self, run_id: str, name: str) -> object:
        return json.loads(get_text(self.spark, f"{self.root}/artifacts/{run_id}/{name}"))

    def runs(self) -> DataFrame:
        return self._read("runs", RUN_DDL)

    def completed(self) -> dict[str, dict[str, float]]:
        return {r["name"]: dict(r["metrics"]) for r in latest_finished(self.runs()).collect()}

    def save_model(self, fitted: PipelineModel) -> str:
        """Where a run's model is kept; the run names it in its tag model_uri."""
        uri = f"{self.root}/run-models/{uuid.uuid4().hex}"
        fitted.write().save(uri)
        return uri

    def run_model(self, name: str) -> PipelineModel:
        """The model of the latest finished run of a name."""
        row = latest_finished(self.runs()).where(F.col("name") == name).select(F.try_element_at("tags", F.lit("model_uri")).alias("uri")).first()
        if row is None or row["uri"] is None:
            raise LookupError(f"no finished run of {name} has a model")
        return PipelineModel.load(row["uri"])

    def versions(self) -> DataFrame:
        return self._read("versions", VERSION_DDL)

    def aliases(self) -> DataFrame:
        """The alias rows in force: the last one set of each model and alias."""
        rows = self._read("aliases", ALIAS_DDL)
        w = Window.partitionBy("model", "alias").orderBy(F.desc("set_at"))
        return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")

    def register(self, model: str, run_name: str, fitted: PipelineModel, tags: dict | None = None) -> int:
        version = (self.versions().where(F.col("model") == model).agg(F.max("version")).first()[0] or 0) + 1
        uri = f"{self.root}/models/{model}/{version}"
        fitted.write().overwrite().save(uri)
        self._put("versions", {"model": model, "version": version, "run_name": run_name, "uri": uri, "created": time.time(), "tags": {k: str(v) for k, v in (tags or {}).items()}})
        return version

    def set_alias(self, model: str, alias: str, version: int) -> None:
        self._put("aliases", {"model": model, "alias": alias, "version": version, "set_at": time.time()})

    def resolve(self, model: str, *aliases: str) -> str:
        """The folder of the version behind the first alias that is set, in the given order."""
        joined = self.aliases().where(F.col("model") == model).join(self.versions(), ["model", "version"])
        found = {r["alias"]: r["uri"] for r in joined.select("alias", "uri").collect()}
        for a in aliases:
            if a in found:
                return found[a]
        raise LookupError(f"{model} has none of the aliases {aliases}; set are {sorted(found)}")

    def load(self, model: str, *aliases: str) -> PipelineModel:
        return PipelineModel.load(self.resolve(model, *aliases))
