"""Curation, code map, stages, splits, tournament, tracking, streaming, reports."""

import json
import math
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidemill.ml import report, stages
from tidemill.ml.features import FeatureSpec, feature_names, feature_stages, importances
from tidemill.ml.specs import ModelSpec, default_specs, evaluators
from tidemill.ml.tournament import Outcome, Settings, best_index, label_shift, profile_stages, register_winner, run_tournament, winner
from tidemill.ml.tracking import Tracker
from tidemill.operators import codemap, curate, metrics, split
from tidemill.plans.contract import LEAKY_COLUMNS, LeakagePolicy, ServingContract
from tidemill.sources import files, sinks
from tidemill.streaming import score as scoring


def synthetic(spark, n=600):
    i = F.col("id")
    return spark.range(n).select(
        "id",
        *(F.lit(v).alias(c) for c, v in (("ORIGIN_LAT", 47.45), ("ORIGIN_LON", -122.31), ("DEST_LAT", 28.43), ("DEST_LON", -81.31), ("DISTANCE", 2554.0), ("SCHEDULED_TIME", 330.0))),
        F.when(i % 50 == 0, 900.0).otherwise((i % 37 - 12).cast("double")).alias("DEPARTURE_DELAY"),
        F.concat(F.lit("AP"), (i % 8).cast("string")).alias("ORIGIN_AIRPORT"),
    ).withColumn("label", F.col("DEPARTURE_DELAY") * 0.9 + 3)


SPEC = FeatureSpec(
    clipped=("DEPARTURE_DELAY",), clipped_to=("delay_clip",), logged=("DISTANCE",), logged_to=("log_distance",), encoded=("ORIGIN_AIRPORT",), encoded_to=("te_origin",),
    indexed=("ORIGIN_AIRPORT",), indexed_to=("origin_idx",), one_hot=("origin_idx",), plain=("DEPARTURE_DELAY", "SCHEDULE_SPEED_MPH", "ROUTE_DETOUR"),
)


def test_geo_stage_native_equals_arrow(spark):
    df = synthetic(spark, 5)
    geo = {"inputCols": list(SPEC.geo_from), "outputCols": list(SPEC.geo_to)}
    a, b = stages.GeoFeatures(**geo).transform(df).first(), stages.GeoFeatures(**geo, variant="arrow").transform(df).first()
    assert abs(a["GC_DISTANCE_MI"] - 2554) < 5 and all(abs(a[c] - b[c]) < 1e-6 for c in ("GC_DISTANCE_MI", "ROUTE_DETOUR", "SCHEDULE_SPEED_MPH"))


def test_fences_come_from_training_rows_only(spark):
    train, test = split.train_test_split(synthetic(spark), "id")
    model = stages.IQRClip(inputCols=["DEPARTURE_DELAY"], outputCols=["c"], relativeError=0.0).fit(train)
    lo, hi = model.bounds()["DEPARTURE_DELAY"]
    got = model.transform(test.unionByName(test.limit(1).withColumn("DEPARTURE_DELAY", F.lit(1e9)))).agg(F.min("c"), F.max("c")).first()
    assert got[0] >= lo and got[1] == hi < 900
    with pytest.raises(ValueError, match="no fences"):
        stages.IQRClipper(inputCols=["a"], outputCols=["b"]).bounds()
    with pytest.raises(ValueError, match="no value"):
        stages.IQRClip(inputCols=["x"], outputCols=["y"]).fit(spark.createDataFrame([(None,)], "x double"))


def test_clipper_alone_uses_its_own_data(spark):
    out = stages.ClipToOwn(inputCols=["DEPARTURE_DELAY"], outputCols=["c"]).transform(synthetic(spark))
    assert out.agg(F.max("c")).first()[0] < 900


def test_encoder_nulls_unseen_and_both_paths(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 4.0), (None, 7.0), ("c", None)], "k string, label double")
    enc = stages.SmoothedTargetEncoder(inputCols=["k"], outputCols=["e"], smoothing=2.0)
    model, prior = enc.fit(df), 4.0
    want = {"a": (1 + 2 * prior) / 4, "b": (4 + 2 * prior) / 3, "c": prior}
    assert model.mapping()["k"] == pytest.approx(want)
    joined = model.copy({model.maxInline: 0})
    probe = spark.createDataFrame([("a",), ("b",), ("c",), ("new",), (None,)], "k string")
    for m in (model, joined):
        assert {r["k"]: r["e"] for r in m.transform(probe).collect()} == pytest.approx({**want, "new": prior, None: prior})
    empty = enc.fit(df.limit(0))
    assert empty.transform(probe).agg(F.sum("e")).first()[0] == 0.0


def test_chain_saves_and_loads(spark, tmp_path):
    train, test = split.train_test_split(synthetic(spark), "id")
    mine, other = stages.HeldRows(), stages.HeldRows()
    chain = [*feature_stages("label", False, spec=SPEC, held=mine), LinearRegression(featuresCol="features", labelCol="label", regParam=0.01)]
    model = Pipeline(stages=chain).fit(train)
    assert other.release() == 0 and mine.release() == 1 and mine.release() == 0
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    mark = lambda m: m.transform(test).agg(F.round(F.sum("prediction"), 6)).first()[0]
    assert mark(model) == mark(again)
    names = feature_names(model, test)
    assert len(names) == len(model.stages[-1].coefficients) and "DEPARTURE_DELAY" in names
    assert importances(model, names)[0][1] >= importances(model, names)[-1][1]


def test_pca_arm_names(spark):
    with stages.HeldRows() as held:
        chain = feature_stages("label", True, 2, SPEC, held)
        model = Pipeline(stages=[*chain, LinearRegression(featuresCol="features", labelCol="label")]).fit(synthetic(spark))
    assert feature_names(model, synthetic(spark)) == ["pc_1", "pc_2"]


def test_cache_stage_does_nothing_on_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = files.scan_json_stream(spark, str(tmp_path / "in"), spark.range(1).schema)
    cache = stages.FitCache()
    assert cache.fit(stream).transform(stream).isStreaming and cache.held.release() == 0


def test_leakage_policy(spark):
    df = spark.createDataFrame([(1, 2, 3)], "MONTH int, ARRIVAL_DELAY int, CANCELLED int")
    policy = LeakagePolicy()
    clean = policy.drop(df)
    assert clean.columns == ["MONTH"] and len(LEAKY_COLUMNS) == 15
    policy.check(clean)
    for bad in (df, clean.withColumn("NEW_RAW", F.lit(1))):
        with pytest.raises(ValueError):
            policy.check(bad)


def test_contract_round_trip(spark, tmp_path):
    df = spark.createDataFrame([], "a int, b string, c double, d bigint, e array<int>, label double")
    path = str(tmp_path / "c.json")
    ServingContract.of(df, ["label"], 49.0).publish(path)
    back = ServingContract.load(path)
    assert back.schema == df.drop("label").schema and back.glm_offset == 49.0
    with pytest.raises(FileNotFoundError):
        ServingContract.load(str(tmp_path / "none.json"))


FACT = {"MONTH": "10", "DAY_OF_WEEK": "6", "AIRLINE": "AS", "ORIGIN_AIRPORT": "10135", "DESTINATION_AIRPORT": "MCO", "SCHEDULED_DEPARTURE": "0005", "SCHEDULED_ARRIVAL": "2400", "WHEELS_OFF": "",
        "ARRIVAL_DELAY": "31", "DEPARTURE_DELAY": "5", "TAXI_OUT": "9", "CANCELLED": "0", "DIVERTED": "0"}


def test_curation_end_to_end(spark, tmp_path):
    rows = [FACT, FACT | {"ARRIVAL_DELAY": "30"}, FACT | {"CANCELLED": "1"}, FACT | {"DIVERTED": ""}, FACT | {"TAXI_OUT": ""}, FACT | {"ORIGIN_AIRPORT": "99999"}]
    raw = tmp_path / "f.csv"
    raw.write_text(",".join(files.FACT_COLUMNS) + "\n" + "".join(",".join(r.get(c, "") for c in files.FACT_COLUMNS) + "\n" for r in rows))
    df = files.scan_csv(spark, str(raw), files.FACT_SCHEMA)
    places = spark.createDataFrame([("ABE", 40.0, -75.0), ("MCO", 28.0, -81.0)], "IATA_CODE string, LATITUDE double, LONGITUDE double")
    carriers = spark.createDataFrame([("AS", "Alpine")], "IATA_CODE string, AIRLINE string")
    codes = spark.createDataFrame([("10135", "ABE")], "dot_code string, iata_code string")
    out = curate.curate(df, places, carriers, codes)
    got = out.orderBy("label_delay").collect()
    assert [(r["label_delay"], r["label_severe"], r["ORIGIN_AIRPORT"], r["SCHED_DEP_MIN"], r["SCHED_ARR_MIN"], r["WHEELS_OFF_MIN"], r["IS_WEEKEND"], r["ROUTE"], r["AIRLINE_NAME"]) for r in got] == [
        (30.0, 0.0, "ABE", 5, 0, None, 1, "ABE-MCO", "Alpine"),
        (31.0, 1.0, "ABE", 5, 0, None, 1, "ABE-MCO", "Alpine"),
    ]
    assert not set(out.columns) & set(LEAKY_COLUMNS)
    sinks.write_partitioned(df, str(tmp_path / "p"), "MONTH", salt=2)
    assert sinks.verify_written(spark, str(tmp_path / "p"), 6).startswith("OK") and sinks.verify_written(spark, str(tmp_path / "p"), 5).startswith("MISMATCH")
    plan = spark.read.parquet(str(tmp_path / "p")).where("MONTH = 10")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(MONTH" in plan


def test_small_tables_are_broadcast_and_large_ones_not(spark):
    assert "broadcast" in curate.small(spark.range(10))._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in curate.small(spark.range(10), most=1)._jdf.queryExecution().analyzed().toString().lower()


def test_vote_ties_go_to_the_smaller_code(spark):
    ddl = "k int, o string, d string"
    enc = spark.createDataFrame([(1, "100", "200"), (2, "100", "201")], ddl)
    cln = spark.createDataFrame([(1, "B", "X"), (2, "A", "Y"), (3, "A", "Y"), (3, "Y", "A")], ddl)
    got = {r["dot_code"]: r["iata_code"] for r in codemap.vote_mapping(enc, cln, ["k"], "o", "d").collect()}
    assert got == {"100": "A", "200": "X", "201": "Y"}


def test_refit_acceptance_rule():
    assert codemap.acceptable(10, 25, 35) and codemap.acceptable(1, 4.5, 5) and codemap.acceptable(0.1, 2.4, 2.5)
    assert not codemap.acceptable(10.1, 99, 999) and not codemap.acceptable(5, 10, 15)


def test_code_map_recovers_what_votes_miss(spark):
    names = {"A": (40.0, -100.0), "B": (30.0, -90.0), "C": (45.0, -80.0), "D": (35.0, -110.0), "E": (25.0, -81.0)}
    coords = spark.createDataFrame([(k, *v) for k, v in names.items()], "iata string, lat double, lon double")
    from tidemill.ml.stages import S

    pairs = [(a, b) for a in names for b in names if a < b]
    p = spark.createDataFrame([(i, a, b, *names[a], *names[b]) for i, (a, b) in enumerate(pairs)], "k int, a string, b string, w double, x double, y double, z double")
    p = p.withColumn("dist", F.round(S.haversine_miles("w", "x", "y", "z")))
    code = lambda c: F.concat(F.lit("1"), F.ascii(c).cast("string"))
    clean = p.where("a <> 'E' and b <> 'E'").select("k", F.lit(1).alias("m"), F.col("a").alias("o"), F.col("b").alias("d"), "dist")
    encoded = p.select("k", F.lit(10).alias("m"), code("a").alias("o"), code("b").alias("d"), "dist")
    got = {r["dot_code"]: (r["iata_code"], r["source"]) for r in codemap.code_map(clean.unionByName(encoded), coords, "m", ["k", "dist"], "o", "d", "dist").collect()}
    assert got == {"165": ("A", "vote"), "166": ("B", "vote"), "167": ("C", "vote"), "168": ("D", "vote"), "169": ("E", "geometric")}


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(2000)
    ids = lambda d: sorted(r[0] for r in d.collect())
    a, b = split.train_test_split(df, "id")
    assert ids(a) == ids(split.train_test_split(df.repartition(7), "id")[0]) and len(ids(a)) + len(ids(b)) == 2000
    # A sample of a split falls into all folds, about evenly: the three choices don't go together.
    folds = {r["fold"]: r["count"] for r in split.with_folds(split.hash_sample(split.train_test_split(spark.range(20_000), "id")[0], "id", 50), "id", 5).groupBy("fold").count().collect()}
    assert len(folds) == 5 and 600 < sum(folds.values()) < 1000 and min(folds.values()) > 100


def regressor(name="lr", grid=(("regParam", (0.01, 0.1)),)):
    return ModelSpec(name, "regression", "label", lambda: LinearRegression(maxIter=5), grid)


class Broken(ModelSpec):
    def estimator(self):
        raise RuntimeError("no such model")


def test_tournament_resumes_isolates_failures_and_registers(spark, tmp_path):
    tracker = Tracker(spark, str(tmp_path / "store"))
    s = Settings("id", folds=2, parallelism=2, pca_k=2, tune_per_mille=1000, label="label", features=SPEC, results_path=str(tmp_path / "r.json"))
    specs = [regressor(), Broken("bad", "regression", "label", LinearRegression)]
    out = run_tournament(synthetic(spark), specs, tracker, s)
    assert set(out.results) == {"lr__pca", "lr__nopca"} and set(out.failures) == {"bad__pca", "bad__nopca"}
    assert set(json.loads((tmp_path / "r.json").read_text())) == {"results", "failures"}
    assert winner(out.results) == "lr__nopca" and "pca_variance_retained" in out.results["lr__pca"]
    assert register_winner(out, tracker) == 1
    again = run_tournament(synthetic(spark), [regressor()], tracker, s)
    assert all(r.get("resumed") for r in again.results.values()) and not again.models
    assert register_winner(again, tracker) == 1
    assert tracker.resolve("best_pipeline", "nothing", "production").endswith("/1")
    assert tracker.load("best_pipeline", "production").transform(synthetic(spark, 3)).count() == 3
    with pytest.raises(LookupError):
        tracker.resolve("best_pipeline", "nothing")
    s.fail_fast, s.results_path = True, None
    with pytest.raises(RuntimeError):
        run_tournament(synthetic(spark), specs[1:], tracker, s)
    text = report.markdown_table(report.load_results(tracker))
    assert text.index("nopca") < text.index("| lr | pca")
    assert report.load_results(path=str(tmp_path / "r.json")).keys() == out.results.keys()


def test_half_run_does_not_count_as_finished(spark, tmp_path):
    t = Tracker(spark, str(tmp_path))
    assert t.completed() == {}
    t.log_run("a__pca", "regression", {"cv_best": 1.0}, status="FAILED", started=1.0)
    t.log_run("b__pca", "regression", {"rmse": 2.0}, started=2.0)
    t.log_run("b__pca", "regression", {"rmse": 1.0}, started=3.0)
    t.log_run("plain", "regression", {"rmse": 0.0}, started=4.0)
    assert t.completed() == {"b__pca": {"rmse": 1.0}}
    with pytest.raises(LookupError):
        register_winner(Outcome({"b__pca": {"task": "regression", "metrics": {"rmse": 1.0}}}, {}, {}, 1.0), t)


def test_best_index_and_shift(spark):
    assert best_index([1.0, 3.0, 3.0], True) == 1 and best_index([2.0, 1.0, 1.0], False) == 1
    assert label_shift(spark.createDataFrame([(-48.0,), (3.0,)], "y double"), "y") == 49.0
    assert label_shift(spark.createDataFrame([(4.0,)], "y double"), "y") == 1.0


def test_specs():
    specs = default_specs()
    assert len(specs) == 7 and sum(s.task == "regression" for s in specs) == 4


@pytest.mark.parametrize("spec", default_specs(), ids=lambda s: s.name)
def test_spec_builds(spark, spec):
    est = spec.estimator()
    assert est.getLabelCol() == spec.label and len(spec.param_maps(est)) >= 2
    assert next(iter(evaluators(spec.task, spec.label))) in ("rmse", "areaUnderROC")


def test_profile(spark):
    geo = stages.GeoFeatures(inputCols=list(SPEC.geo_from), outputCols=list(SPEC.geo_to))
    rows = profile_stages([geo, VectorAssembler(inputCols=["DISTANCE"], outputCol="v")], synthetic(spark, 20))
    assert [r[0] for r in rows] == ["GeoFeatures", "VectorAssembler", "pipeline"]


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    train = synthetic(spark).withColumn("DEPARTURE_DELAY", F.col("DEPARTURE_DELAY").cast("int"))
    chain = [stages.SmoothedTargetEncoder(inputCols=["ORIGIN_AIRPORT"], outputCols=["te"]), VectorAssembler(inputCols=["te", "DEPARTURE_DELAY"], outputCol="features", handleInvalid="keep")]
    model = Pipeline(stages=[*chain, LinearRegression(labelCol="label")]).fit(train)
    contract = ServingContract.of(train.select("ORIGIN_AIRPORT", "DEPARTURE_DELAY", "DISTANCE", "label"), ["label"])
    events = [{"ORIGIN_AIRPORT": f"AP{k % 9}", "DEPARTURE_DELAY": 2 * k, "DISTANCE": 100.0 + k, "OTHER": k} for k in range(15)]
    for k in range(3):
        sinks.put_events(str(tmp_path / "in"), f"e{k}.json", events[5 * k : 5 * k + 5])
    counter = scoring.RowCounter()
    spark.streams.addListener(counter)
    try:
        q = scoring.start_scoring(spark, str(tmp_path / "in"), contract, model, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert scoring.drain(q)
    finally:
        spark.streams.removeListener(counter)
    got = spark.read.parquet(str(tmp_path / "out")).drop("scored_at", "batch")
    want = scoring.score(spark.read.schema(contract.schema).json(str(tmp_path / "in")), model, stamp=False)
    assert got.count() == 15 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert not [p for p in os.listdir(tmp_path / "in") if p.endswith(".part")]
    with pytest.raises(ValueError, match="belongs to"):
        scoring.start_scoring(spark, str(tmp_path / "in"), contract, model, str(tmp_path / "out"), str(tmp_path / "cp2"))


def test_console_sink(spark, tmp_path):
    sinks.put_events(str(tmp_path / "in"), "e.json", [{"id": 1}])
    q = scoring.start_console_sink(files.scan_json_stream(spark, str(tmp_path / "in"), spark.range(1).schema), every="1 second")
    assert scoring.drain(q, 1) is False and q.exception() is None


def test_winner_that_was_never_registered(spark, tmp_path):
    tracker = Tracker(spark, str(tmp_path / "store"))
    s = Settings("id", folds=2, parallelism=1, pca_k=2, tune_per_mille=1000, label="label", features=SPEC)
    run_tournament(synthetic(spark), [regressor(grid=(("regParam", (0.01,)),))], tracker, s, arms=("nopca",))  # and then the process dies
    again = run_tournament(synthetic(spark), [regressor()], tracker, s, arms=("nopca",))
    assert not again.models and register_winner(again, tracker) == 1
    assert tracker.load("best_pipeline", "production").transform(synthetic(spark, 3)).count() == 3
    params = tracker.runs().first()["params"]
    assert params["param_maxIter"] == "5" and params["folds"] == "2" and "DISTANCE" in params["features"]
    paths = report.write_benchmark(tracker, str(tmp_path / "out"), tracker.load("best_pipeline", "staging").transform(synthetic(spark)), "label")
    names = {os.path.basename(p) for p in paths}
    assert {"results_table.md", "arms_regression.json", "importances_lr__nopca.json", "residuals.json"} <= names
    assert sum(n for _, n in json.loads((tmp_path / "out/residuals.json").read_text())) > 500


def test_sample_and_tuning_choices_are_independent(spark):
    df = spark.range(40_000)
    both = split.hash_sample(split.hash_sample(df, "id", 500, split.SAMPLE), "id", 20).count()
    assert 300 < both < 500  # 2 % of a half
    keyless = spark.createDataFrame([(None,), (1,)], "id long")
    parts = split.train_test_split(keyless, "id")
    assert [r["id"] for r in parts[1].where("id is null").collect()] == [None] and parts[0].where("id is null").count() == 0


def test_cli_from_feed_to_scores(spark, tmp_path, capsys):
    from tidemill.cli import main

    feed = tmp_path / "f.csv"
    rows = []
    for k in range(400):
        rows.append(FACT | {"MONTH": str(k % 12 + 1), "DAY": str(k % 28 + 1), "DAY_OF_WEEK": str(k % 7 + 1), "FLIGHT_NUMBER": str(k), "ORIGIN_AIRPORT": ("ABE", "MCO")[k % 2], "DESTINATION_AIRPORT": ("MCO", "ABE")[k % 2],
                     "SCHEDULED_DEPARTURE": f"{k % 24:02d}15", "WHEELS_OFF": f"{k % 24:02d}30", "SCHEDULED_ARRIVAL": f"{(k + 2) % 24:02d}10", "DISTANCE": str(880 + k % 5), "SCHEDULED_TIME": str(150 + k % 9),
                     "DEPARTURE_DELAY": str(k % 41 - 9), "TAXI_OUT": str(8 + k % 11), "ARRIVAL_DELAY": str(k % 41 - 9 + k % 7), "CANCELLED": str(int(k % 50 == 0))})
    feed.write_text(",".join(files.FACT_COLUMNS) + "\n" + "".join(",".join(r.get(c, "") for c in files.FACT_COLUMNS) + "\n" for r in rows))
    (tmp_path / "places.csv").write_text("IATA_CODE,LATITUDE,LONGITUDE\nABE,40.6,-75.4\nMCO,28.4,-81.3\n")
    (tmp_path / "carriers.csv").write_text("IATA_CODE,AIRLINE\nAS,Alpine\n")
    at = lambda n: str(tmp_path / n)
    assert main(["raw", "--facts", at("f.csv"), "--out", at("raw")]) == 0
    assert main(["prepare", "--facts", at("raw"), "--places", at("places.csv"), "--carriers", at("carriers.csv"), "--out", at("curated")]) == 0
    said = capsys.readouterr().out
    assert "OK (400 rows)" in said and "not cancelled: 392" in said and "curated: 392" in said and "severe:" in said
    store = ["--store", at("store"), "--experiment", "e1"]
    assert main(["train", "--curated", at("curated"), "--key", "FLIGHT_NUMBER", *store, "--folds", "2", "--models", "linear_regression", "--arms", "nopca", "--tune-per-mille", "1000"]) == 0
    assert (tmp_path / "store/e1/input_schema.json").exists() and "linear_regression__nopca" in (tmp_path / "store/e1/tournament_results.json").read_text()
    assert main(["events", "--curated", at("curated"), "--key", "FLIGHT_NUMBER", *store, "--out", at("in"), "--rows", "30", "--batch", "10"]) == 0
    capsys.readouterr()
    assert main(["score", "--source", at("in"), *store, "--out", at("scored")]) == 0
    said = capsys.readouterr().out
    assert "in 3 batches" in said and spark.read.parquet(at("scored")).count() == 30
    assert main(["report", *store]) == 0 and "linear_regression" in capsys.readouterr().out
    assert main(["benchmark", *store, "--out", at("figures"), "--curated", at("curated"), "--key", "FLIGHT_NUMBER"]) == 0 and (tmp_path / "figures/residuals.json").exists()
    assert main(["profile", "--curated", at("curated"), "--rows", "200"]) == 0 and "pipeline" in capsys.readouterr().out


def test_stream_schema_mismatch_gives_nulls(spark, tmp_path):
    sinks.put_events(str(tmp_path), "e.json", [{"a": 1}, {"a": "x"}])
    rates = {r["column"]: r["null_rate"] for r in scoring.null_rates(spark.read.schema("a int, b int").json(str(tmp_path))).collect()}
    assert rates == {"a": 0.5, "b": 1.0}


def test_parquet_sink_and_timed_drain(spark, tmp_path):
    sinks.put_events(str(tmp_path / "in"), "e.json", [{"id": 1}])
    stream = files.scan_json_stream(spark, str(tmp_path / "in"), spark.range(1).schema)
    q = scoring.start_parquet_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp"), every="1 second")
    assert scoring.drain(q, 2) is False
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_find_source(tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEMILL_RAW_DIR", str(tmp_path))
    (tmp_path / "x.csv").write_text("a\n1\n")
    assert files.find_source("x.csv") == str(tmp_path / "x.csv")
    with pytest.raises(FileNotFoundError, match=str(tmp_path)):
        files.find_source("y.csv")


def test_onehot_drops_last(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    model = OneHotEncoder(inputCols=["x"], outputCols=["v"], handleInvalid="keep").fit(df)
    assert model.transform(df).first()["v"].size == 3


def test_cli_rejects_a_path_as_results_name():
    from tidemill.cli import _args

    base = ["train", "--curated", "c", "--store", "s", "--key", "k"]
    assert _args([*base, "--results-name", "r.json"]).results_name == "r.json"
    with pytest.raises(SystemExit):
        _args([*base, "--results-name", "../r.json"])
    with pytest.raises(SystemExit) as e:
        _args(["nonsense"])
    assert e.value.code == 2


def test_default_chain_over_a_table_of_full_shape(spark):
    from tests.conftest import SF
    from tidemill.plans.training import chain_metrics, fit_chain, flights

    rows = flights(spark, SF)
    model = fit_chain(rows)
    names = feature_names(model, rows)
    assert len(names) == len(model.stages[-1].coefficients)
    raw = model.stages[:-3]
    assert sum(n.startswith("te_") for n in names) == 3 and "dep_delay_clip" in names and len(raw) > 5
    assert chain_metrics(spark, SF).first()["r2"] > 0.9


def test_held_out_events_are_the_same_each_time(spark):
    df = synthetic(spark)
    contract = ServingContract.of(df.select("DISTANCE", "ORIGIN_AIRPORT", "label"), ["label"])
    a = scoring.held_out_events(df, "id", contract, 7)
    assert len(a) == 7 and a == scoring.held_out_events(df.repartition(5), "id", contract, 7) and set(a[0]) == {"DISTANCE", "ORIGIN_AIRPORT"}


def test_scans_read_only_what_they_need(spark):
    from tests.conftest import SF
    from tidemill.plans.queries import QUERIES

    plan = lambda n: QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan("project_subset")
    assert plan("curation_funnel").count("FileScan parquet") == 1 and plan("target_encode_fit").count("FileScan parquet") == 1
    assert "l_extendedprice" not in plan("dim_enrich") and "CartesianProduct" not in plan("dim_enrich")
    assert "Python" not in plan("derive_features") and "ArrowEvalPython" in plan("haversine_udf")


def test_store(spark, tmp_path):
    from tidemill.sources.store import exists, put_text, work_folder

    path = f"file://{tmp_path}/a/b.json"
    assert not exists(spark, path)
    put_text(spark, path, '{"é": 1}')
    assert exists(spark, path) and (tmp_path / "a/b.json").read_text() == '{"é": 1}'
    assert work_folder(spark, "x") != work_folder(spark, "x")


@pytest.mark.parametrize("n", [2, 3, 700])
def test_auc_equals_pair_counting(spark, n):
    from tidemill.operators import metrics

    rows = [(int(k * 7919 % 13 < 5) if k > 1 else k, float(k * 31 % 97)) for k in range(n)] + [(1, None)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = ([s for y, s in rows if y == v and s is not None] for v in (1, 0))
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.auc(df, "y", "s").first()[0] == pytest.approx(want)
    assert metrics.auc(df.limit(0), "y", "s").first()[0] is None


def test_residual_percentiles_near_exact(spark):
    from tidemill.operators import metrics

    df = spark.range(20_001).select((F.col("id") / 1000).alias("r"))
    a, b = (metrics.residual_summary(df, F.col("r"), acc).first() for acc in (None, 10_000))
    assert a["n"] == b["n"] and all(abs(a[c] - b[c]) < 0.01 for c in ("p00_5", "p01", "p99", "p99_5"))


# --- values of fitted models -------------------------------------------------------------------------


def numbers(spark, n=400):
    import numpy as np

    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(n, 2)), 3)
    y = np.round(np.exp(0.4 * x[:, 0] - 0.2 * x[:, 1] + 1.0) + r.random(n), 3)
    c = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * r.normal(size=n) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(t), float(k)) for (a, b), t, k in zip(x, y, c, strict=True)], "a double, b double, y double, c double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).persist(), x, y, c


def spec_of(name, **params):
    est = next(s for s in default_specs("y", "c", "y") if s.name == name).estimator()
    return est.setParams(**params) if params else est


def test_poisson_model_solves_its_equations(spark):
    import numpy as np

    df, x, y, _ = numbers(spark)
    m = spec_of("glm_poisson_log", regParam=0.0, maxIter=50).fit(df)
    mu = np.exp(x @ m.coefficients.toArray() + m.intercept)
    assert np.abs(np.column_stack([x, np.ones(len(x))]).T @ (y - mu)).max() < 1e-4  # the score of a Poisson model with log link
    got = [r["prediction"] for r in m.transform(df).select("prediction").collect()]
    assert np.allclose(got, mu)


def test_svc_is_near_the_least_loss(spark):
    import numpy as np

    df, x, _, c = numbers(spark)
    m = spec_of("linear_svc", regParam=0.05, maxIter=60, tol=1e-8, standardization=False).fit(df)

    def loss(w, b):
        return np.maximum(0, 1 - (2 * c - 1) * (x @ w + b)).mean() + 0.05 / 2 * (w @ w)

    w, b = np.zeros(2), 0.0
    for k in range(6000):  # a plain subgradient descent
        on = ((2 * c - 1) * (x @ w + b) < 1) * (2 * c - 1)
        step = 1.0 / (0.05 * (k + 50))
        w, b = w - step * (0.05 * w - (on[:, None] * x).mean(axis=0)), b + step * on.mean()
    assert loss(m.coefficients.toArray(), m.intercept) < loss(w, b) + 2e-3
    side = np.array([r["prediction"] for r in m.transform(df).collect()])
    assert (side == (x @ m.coefficients.toArray() + m.intercept > 0)).all()


@pytest.mark.parametrize("name", ["random_forest_regressor", "random_forest_classifier", "gbt_regressor", "gbt_classifier"])
def test_trees_predict_from_their_leaves(spark, name):
    """Every tree by itself, as written out by the model, against the model's prediction."""
    import numpy as np

    df, x, y, c = numbers(spark)
    small = {"numTrees": 5, "maxDepth": 3} if "forest" in name else {"maxIter": 5, "maxDepth": 3}
    m = spec_of(name, **small).fit(df)

    def walk(node, row):
        while node.numDescendants() > 0:
            split = node.split()
            go_left = row[split.featureIndex()] <= split.threshold()
            node = node.leftChild() if go_left else node.rightChild()
        return node

    trees, rows = [t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode") for t in m.trees], x[:40].tolist()
    got = [r["prediction"] for r in m.transform(df).limit(40).collect()]
    if name == "random_forest_regressor":
        want = [np.mean([walk(t, r).prediction() for t in trees]) for r in rows]
    elif name == "random_forest_classifier":
        want = []
        for r in rows:
            votes = np.zeros(2)
            for t in trees:
                s = np.array(list(walk(t, r).impurityStats().stats()))
                votes += s / s.sum()
            want.append(float(votes.argmax()))
    else:
        sums = [sum(w * walk(t, r).prediction() for w, t in zip(m.treeWeights, trees, strict=True)) for r in rows]
        want = sums if name == "gbt_regressor" else [float(v > 0) for v in sums]
    assert np.allclose(got, want)
    if name == "gbt_regressor":  # the first tree's leaves hold the mean label of their rows
        leaves = [walk(trees[0], r).prediction() for r in x.tolist()]
        for v in set(leaves):
            assert y[np.array(leaves) == v].mean() == pytest.approx(v)


def test_lookup_by_checksum(spark):
    from tidemill.functions.scalar import mapped

    table = {f"key é{k}": float(k) for k in range(500)}
    df = spark.createDataFrame([(f"key é{k}",) for k in range(-5, 505)] + [(None,), ("",)], "k string")
    got = {r["k"]: r["v"] for r in df.select("k", mapped("k", table, -1.0).alias("v")).collect()}
    assert got == {k: table.get(k, -1.0) for k in got}
    assert df.select(mapped("k", {}, 2.0).alias("v")).agg(F.min("v"), F.max("v")).first()[:] == (2.0, 2.0)


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_exact_quantiles(spark, n):
    import numpy as np

    from tidemill.operators import metrics

    values = [float((k * 7919 % 1013) // 3) for k in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(4)
    shares = (0.0, 0.005, 0.5, 0.99, 1.0)
    assert metrics.quantiles(df, F.col("v"), shares, between=True) == pytest.approx(np.quantile(values, shares).tolist())
    assert metrics.quantiles(df, F.col("v"), shares[1:]) == np.quantile(values, shares[1:], method="inverted_cdf").tolist()
    assert metrics.quantiles(df.limit(0), F.col("v"), (0.5,)) == [None]


def test_large_vocabulary_is_a_table(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 50}", float(i)) for i in range(500)] + [(None, 3.0)], "k string, label double")
    inline, table = (stages.SmoothedTargetEncoder(inputCols=["k"], outputCols=["e"], maxInline=n, **more) for n, more in ((50, {}), (49, {"tableFolder": str(tmp_path / "means")})))
    a, b = inline.fit(df), table.fit(df)
    assert len(a.mapping()["k"]) == 50 and not b.mapping() and b.isSet(b.tableUri)
    PipelineModel([b]).write().overwrite().save(str(tmp_path / "m"))
    shutil.rmtree(tmp_path / "means")  # the saved model needs nothing else
    shutil.move(tmp_path / "m", tmp_path / "elsewhere")
    b = PipelineModel.load(str(tmp_path / "elsewhere"))
    b.write().overwrite().save(str(tmp_path / "again"))
    shutil.rmtree(tmp_path / "elsewhere")
    b = PipelineModel.load(str(tmp_path / "again"))
    probe = df.limit(60).unionByName(spark.createDataFrame([("new", 0.0)], df.schema))
    assert sorted(r["e"] for r in a.transform(probe).collect()) == pytest.approx(sorted(r["e"] for r in b.transform(probe).collect()))


# --- event time, grouped medians, hexagons, fingerprints ------------------------------------------------


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    """A query that was stopped, and started anew, writes each row once; a row that comes too late is left out."""
    from tidemill.streaming import windows as W

    when = W.EventTime("ts", "1 hour")
    ddl = "event_id long, ts timestamp, kind string"

    def feed(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join('{"event_id": %d, "ts": "2024-01-01T%s:00Z", "kind": "a"}\n' % r for r in rows))

    def run():
        stream = W.by_window(W.first_copies(W.scan_events(spark, str(tmp_path / "in"), ddl), ["event_id"], when), when, "1 hour", ["kind"], {"n": F.count(F.lit(1))})
        W.take_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        rows = spark.read.parquet(str(tmp_path / "out")).select(F.date_format("begins", "HH").alias("h"), "kind", "n").collect()
        return sorted((r["h"], r["n"]) for r in rows)

    feed("a.json", [(1, "10:10"), (2, "10:20"), (1, "10:10"), (3, "11:30")])
    assert run() == []  # the watermark is 10:30: no hour is complete
    feed("b.json", [(4, "10:50"), (2, "10:20"), (5, "12:10")])  # in time; a copy; the watermark moves to 11:10
    assert run() == [("10", 3)]
    assert run() == [("10", 3)]
    feed("c.json", [(6, "10:55"), (7, "13:05")])  # too late: its hour was written
    assert run() == [("10", 3), ("11", 1)]


@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_grouped_medians(spark, accuracy):
    r = random.Random(2)
    rows = [(f"g{int(r.paretovariate(0.6)) % 12}", r.choice([None, float("nan"), 1.0, 2.0, r.gauss(0, 100)]) if k % 9 == 0 else r.gauss(0, 50)) for k in range(6000)]
    rows = [(g, x if x is None or x == x else None) for g, x in rows] + [("one", 5.0), ("none", None), (None, 1.0)]
    got = {x["g"]: (x["median"], x["n"]) for x in metrics.grouped_medians(spark.createDataFrame(rows, "g string, x double").repartition(3), ["g"], F.col("x"), accuracy).collect()}
    want = {}
    for g, x in rows:
        if g is not None and x is not None:
            want.setdefault(g, []).append(x)
    assert got == {g: (float(np.median(v)), len(v)) for g, v in want.items()}


def test_hexagons_are_the_nearest(spark):
    """Every point lies in the hexagon whose centre is the nearest of all centres, up-distances weighed as the shape asks."""
    r = random.Random(3)
    rows = [(r.uniform(-5, 105), r.uniform(-5, 105)) for _ in range(3000)] + [(None, 1.0), (1.0, None)]
    got = {(x["lattice"], x["hx"], x["hy"]): (x["cx"], x["cy"], x["n"]) for x in metrics.hexagons(spark.createDataFrame(rows, "x double, y double"), F.col("x"), F.col("y"), 0.0, 100.0, 12).collect()}
    up = int(12 / math.sqrt(3))
    sx, sy = 100 / 12, 100 / up
    centres = {(1, i, j): (i * sx, j * sy) for i in range(-2, 16) for j in range(-2, 12)} | {(2, i, j): ((i + 0.5) * sx, (j + 0.5) * sy) for i in range(-2, 16) for j in range(-2, 12)}
    want = {}
    for x, y in rows:
        if x is not None and y is not None:
            k = min(centres, key=lambda c: ((x - centres[c][0]) / sx) ** 2 + 3 * ((y - centres[c][1]) / sy) ** 2)
            if 0 <= k[1] <= 13 - k[0] and 0 <= k[2] <= up + 1 - k[0]:
                want[k] = want.get(k, 0) + 1
    assert {k: n for k, (_, _, n) in got.items()} == want
    assert all(math.isclose(got[k][0], centres[k][0], abs_tol=1e-4) and math.isclose(got[k][1], centres[k][1], abs_tol=1e-4) for k in got)


def test_fingerprints_do_not_depend_on_order(spark):
    r = random.Random(4)
    rows = [(r.uniform(-1, 1) * 10 ** r.randint(-6, 12), k, f"t{k % 5}" if k % 7 else None) for k in range(4000)] + [(float("nan"), None, "x"), (float("inf"), 1, "y")]
    df = spark.createDataFrame(rows, "x double, k long, t string")
    dealt = [df, df.repartition(7), df.orderBy(F.rand(1)), df.coalesce(1)]
    assert len({tuple(metrics.fingerprint(d.select("x", "k")).first()) for d in dealt}) == 1
    assert len({tuple(metrics.multiset(d).first()) for d in dealt}) == 1
    one = metrics.multiset(df).first()["digest"]
    assert len(one) == 32
    assert metrics.multiset(df.unionByName(df.limit(1))).first()["digest"] != one
    assert metrics.multiset(df.withColumn("x", F.when(F.col("k") == 5, F.col("x") + 1e-3).otherwise(F.col("x")))).first()["digest"] != one
    assert tuple(metrics.multiset(df.limit(0)).first()) == (0, "0" * 32)


@pytest.mark.parametrize("few", [codemap.FEW_ERRORS, 0])
def test_candidates_by_ring_are_those_of_all_against_all(spark, monkeypatch, few):
    """Best and runner-up of every code, on a sphere with places at the poles and on both sides of the date line."""
    r = random.Random(6)
    places = [(f"p{k:03}", r.choice([r.uniform(-90, 90), 89.9, -89.9, 0.0]), r.choice([r.uniform(-180, 180), 179.9, -180.0, 180.0])) for k in range(90)]
    at = {n: (la, lo) for n, la, lo in places}

    def miles(a, b):
        (p, q), (s, t) = ([math.radians(x) for x in at[n]] for n in (a, b))
        h = math.sin((s - p) / 2) ** 2 + math.cos(p) * math.cos(s) * math.sin((t - q) / 2) ** 2
        return 2 * 3958.7613 * math.asin(math.sqrt(min(1.0, max(0.0, h))))

    names = sorted(at)
    trusted = {str(1000 + k): n for k, n in enumerate(names[:40])}
    unknown = {str(2000 + k): n for k, n in enumerate(names[40:52])}
    routes = []
    for code, n in unknown.items():
        for other in r.sample(sorted(trusted), r.randint(1, 6)):
            off = r.choice([0.3, 5.0, 90.0, 2500.0]) if r.random() < 0.5 else 0.0
            routes.append((*((code, other) if r.random() < 0.5 else (other, code)), float(round(miles(n, trusted[other]) + off)), 1))
    coords = spark.createDataFrame(places, "iata string, lat double, lon double")
    monkeypatch.setattr(codemap, "FEW_ERRORS", few)
    got = codemap.score_candidates(
        spark.createDataFrame(routes, "origin string, dest string, distance double, n long").distinct(), spark.createDataFrame([(c,) for c in unknown], "code string"), spark.createDataFrame(list(trusted.items()), "dot_code string, iata_code string"), coords
    ).collect()
    seen = set(routes)
    want = {}
    for code in unknown:
        obs = [(trusted[b if a == code else a], d) for a, b, d, _ in seen if code in (a, b)]
        scored = sorted((float(np.median([abs(miles(p, o) - d) for o, d in obs])), p) for p in names if p not in trusted.values())
        want[code] = (scored[0][1], scored[0][0], scored[1][0], len(obs))
    assert {x["code"] for x in got} == set(want)
    for x in got:
        iata, score, runner, n = want[x["code"]]
        assert (x["iata"], x["n_obs"]) == (iata, n) and math.isclose(x["score"], score, abs_tol=1e-6) and math.isclose(x["runner_up"], runner, abs_tol=1e-6)


# --- one vector stage, one chain fit for each fold ------------------------------------------------------


def test_slots_of_seen_categories_equal_a_selector(spark, tmp_path):
    from dataclasses import replace

    from pyspark.ml.functions import vector_to_array

    from tidemill.plans.training import flights
    from tests.conftest import SF

    rows = flights(spark, SF).limit(1500).withColumn("IS_WEEKEND", F.lit(1)).persist()  # a number that doesn't vary
    found = {}
    for seen_only in (True, False):
        model = Pipeline(stages=feature_stages("label_delay", False, spec=replace(FeatureSpec(), seen_only=seen_only))).fit(rows)
        unseen = rows.withColumns({"MONTH": F.lit(12) + F.col("MONTH") % 2, "DAY": F.when(F.col("DAY") > 3, F.col("DAY"))})
        made = [model.transform(d).orderBy("row_id").select(vector_to_array("features").alias("v")).collect() for d in (rows, unseen)]
        found[seen_only] = [np.array([r["v"] for r in m]) for m in made], feature_names(model, rows)
        if seen_only:
            model.write().overwrite().save(str(tmp_path / "m"))
            again = PipelineModel.load(str(tmp_path / "m")).transform(rows).orderBy("row_id").select(vector_to_array("features").alias("v")).collect()
            assert np.array_equal(np.array([r["v"] for r in again]), found[True][0][0])
    for a, b in zip(found[True][0], found[False][0], strict=True):
        assert a.shape == b.shape and np.allclose(a, b, equal_nan=True)
    assert found[True][1] == found[False][1]


def test_one_chain_fit_for_each_fold(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from tidemill.ml.search import cross_validate, fit_best

    fits, tables = [], []

    class Counted(stages.IQRClip):
        def _fit(self, dataset):
            fits.append(1)
            tables.append(spark.sparkContext._jsc.getPersistentRDDs().size())
            return super()._fit(dataset)

    def chain(held):
        return [Counted(inputCols=["DEPARTURE_DELAY"], outputCols=["clip"]), stages.FitCache(held), VectorAssembler(inputCols=["clip", "DISTANCE"], outputCol="features")]

    est = LinearRegression(featuresCol="features", labelCol="label", solver="normal")
    grid = ParamGridBuilder().addGrid(est.regParam, [0.0, 5.0, 50.0]).build()
    rows = synthetic(spark).withColumn("fold", (F.col("id") % 4).cast("int")).withColumn("DISTANCE", F.col("id") % 13 + 0.5)
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    evaluator = RegressionEvaluator(labelCol="label")
    got = cross_validate(chain, est, grid, rows, "fold", 4, evaluator, 3)
    assert len(fits) == 4 and max(tables) == kept and spark.sparkContext._jsc.getPersistentRDDs().size() == kept
    whole = CrossValidator(estimator=Pipeline(stages=[*chain(stages.HeldRows()), est]), estimatorParamMaps=grid, evaluator=evaluator, numFolds=4, foldCol="fold").fit(rows)
    assert np.allclose(got, whole.avgMetrics)
    model = fit_best(chain, est, grid[best_index(got, False)], rows)
    assert np.isclose(evaluator.evaluate(model.transform(rows)), evaluator.evaluate(whole.bestModel.transform(rows)))


# --- malformed records ---------------------------------------------------------------------------------


def test_malformed_lines_are_counted_and_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n,name\n1,10,x\n2,ten,y\n3,30\n4,40,z,extra\n5,,w\nrubbish\n")
    rows = files.scan_csv(spark, str(tmp_path / "a.csv"), "id int, n int, name string", corrupt=True)
    good, bad = sinks.split_corrupt(rows)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 10, "x"), (5, None, "w")] and good.columns == ["id", "n", "name"]
    assert sorted(r["record"] for r in bad.collect()) == ["2,ten,y", "3,30", "4,40,z,extra", "rubbish"]
    assert all(r["file"].endswith("a.csv") for r in bad.collect())
    total = sinks.keep_corrupt(rows, str(tmp_path / "bad"))
    assert total == {"good": 2, "bad": 4} and spark.read.parquet(str(tmp_path / "bad")).count() == 4
    assert sorted(r["id"] for r in good.select("id").collect()) == [1, 5]  # whatever columns are read


def test_stream_keeps_malformed_events_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"x": 1.5, "k": "a"}\n{"x": "wrong", "k": "b"}\nnot json\n{"x": 2.5}\n')
    train = spark.createDataFrame([(float(k), 2.0 * k) for k in range(20)], "x double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LinearRegression(labelCol="y")]).fit(train)
    contract = ServingContract.of(spark.createDataFrame([(1.0, "a")], "x double, k string"), ())
    scoring.drain(scoring.start_scoring(spark, str(tmp_path / "in"), contract, model, str(tmp_path / "out"), str(tmp_path / "c"), keep=("x", "k"), quarantine=str(tmp_path / "bad")))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("x").collect()
    assert [(r["x"], r["k"], round(r["prediction"], 4)) for r in got] == [(1.5, "a", 3.0), (2.5, None, 5.0)]
    assert sorted(r["record"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["not json", '{"x": "wrong", "k": "b"}']


def test_costs_are_those_of_the_jobs(spark):
    from tidemill.ml.measured import Cost, measured

    with measured(spark) as first:
        spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count().collect()
    spark.range(10).count()  # another job in between counts for neither
    double = F.pandas_udf(lambda x: x * 2.0, "double")
    with measured(spark) as second:
        spark.range(5000, numPartitions=2).select(double("id")).write.format("noop").mode("overwrite").save()
    assert first.jobs >= 1 and first.tasks >= first.stages >= 2 and first.shuffle_write_mb == pytest.approx(first.shuffle_read_mb) and first.shuffle_write_mb > 0 and first.python_s == 0
    assert (second.jobs, second.tasks, second.shuffle_write_mb) == (1, 2, 0) and second.python_s > 0 and second.run_s > 0
    both = first + second
    assert both.tasks == first.tasks + second.tasks and both.wall_s == first.wall_s + second.wall_s and Cost() + first == first
    with measured(spark) as whole:  # the parts sum to the whole
        with measured(spark) as part:
            spark.range(100).repartition(2).count()
    assert part.jobs >= 1 and whole.jobs == 0  # a job belongs to the innermost


def test_figures_of_predictions(spark, tmp_path):
    predicted = spark.range(2000).select((F.col("id") % 97).cast("double").alias("label_delay"), (F.col("id") % 97 + F.col("id") % 5 - 2).cast("double").alias("prediction"))
    paths = report.write_benchmark(Tracker(spark, str(tmp_path / "s")), str(tmp_path / "out"), predicted)
    shape = files.read_json(str(tmp_path / "out" / "predicted_actual.json"))
    assert (shape["low"], shape["high"]) == (0.0, 96.0) and sum(n for _, _, n in shape["cells"]) <= 2000 and len(shape["cells"]) > 40
    bins = files.read_json(str(tmp_path / "out" / "residuals.json"))
    assert sum(n for _, n in bins) == 2000 and bins[0][0] == "-2"
    assert report.write_benchmark(Tracker(spark, str(tmp_path / "s")), str(tmp_path / "none"), predicted.limit(0)) and len(paths) >= 3


def test_components_where_the_decomposition_does_not_converge(spark, tmp_path, monkeypatch):
    from pyspark.ml.feature import PCA, PCAModel
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    # Two one-hot groups, whose slots depend on each other, and two numbers.
    rows = [(Vectors.dense([float(k % 3 == i) for i in range(3)] + [float(k % 5 == i) for i in range(5)] + [k * 0.37 % 11, k * k % 17 / 3.0]),) for k in range(400)]
    df = spark.createDataFrame(rows, ["features_selected"])
    want = PCA(k=4, inputCol="features_selected", outputCol="features").fit(df)

    def fails(self, dataset):
        raise RuntimeError("breeze.linalg.NotConvergedException")

    monkeypatch.setattr(PCA, "_fit", fails)
    got = feature_stages("label", True, 4)[-1].fit(df)
    monkeypatch.undo()
    assert type(got).__name__ == "PCAModel" and got.getK() == 4
    assert got.explainedVariance.toArray() == pytest.approx(want.explainedVariance.toArray(), abs=1e-9)
    # The first two shares stand apart, so their components are fixed but for the sign.
    for i in range(2):
        a, b = got.pc.toArray()[:, i], want.pc.toArray()[:, i]
        assert abs(a @ b) == pytest.approx(1.0, abs=1e-9)
    got.write().save(f"file://{tmp_path}/pca")
    back = PCAModel.load(f"file://{tmp_path}/pca")
    out = back.transform(df).select(vector_to_array("features").alias("f")).first()["f"]
    assert out == pytest.approx((rows[0][0].toArray() @ got.pc.toArray()).tolist(), abs=1e-9)

    def other(self, dataset):
        raise RuntimeError("no such column")

    monkeypatch.setattr(PCA, "_fit", other)
    with pytest.raises(RuntimeError, match="no such column"):
        feature_stages("label", True, 4)[-1].fit(df)
