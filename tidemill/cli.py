"""python -m tidemill.cli raw | prepare | encode-map | train | score | report | benchmark | events | windows | profile"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from tidemill.session import build_session

LABELS = ("label_delay", "label_severe")


def _args(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidemill")
    sub = p.add_subparsers(dest="mode", required=True)

    def mode(name: str, *needed: str) -> argparse.ArgumentParser:
        made = sub.add_parser(name)
        for n in needed:
            made.add_argument(n, required=True)
        return made

    raw = mode("raw", "--facts", "--out")
    raw.add_argument("--salt", type=int, default=1, help="tasks and files of each month")
    raw.add_argument("--quarantine", help="folder for lines that don't fit the schema; without one they are rows with nulls")
    mode("prepare", "--facts", "--places", "--carriers", "--out").add_argument("--code-map")
    mode("encode-map", "--facts", "--places", "--out")
    train = mode("train", "--curated", "--store", "--key")
    train.add_argument("--folds", type=int, default=5)
    train.add_argument("--parallelism", type=int, default=4)
    train.add_argument("--pca-k", type=int, default=10)
    train.add_argument("--tune-per-mille", type=int, default=20)
    train.add_argument("--sample-per-mille", type=int, default=1000)
    train.add_argument("--models", nargs="*")
    train.add_argument("--arms", nargs="*", default=["pca", "nopca"])
    train.add_argument("--fail-fast", action="store_true")
    train.add_argument("--fresh", action="store_true", help="run finished arms again")
    train.add_argument("--results-name", default="tournament_results.json")
    score = mode("score", "--source", "--store", "--out")
    score.add_argument("--model", default="best_pipeline")
    score.add_argument("--every")
    score.add_argument("--seconds", type=float)
    score.add_argument("--console", action="store_true")
    score.add_argument("--quarantine", help="folder for events that don't fit the schema; without one what doesn't fit is null")
    mode("report", "--store")
    bench = mode("benchmark", "--store", "--out")
    bench.add_argument("--curated", help="rows for the residuals of the winner's predictions")
    bench.add_argument("--key")
    events = mode("events", "--out")
    events.add_argument("--curated", help="rows that training has not seen are taken from here; without it, and a store, made-up ones")
    events.add_argument("--key")
    events.add_argument("--store")
    events.add_argument("--rows", type=int, default=100)
    events.add_argument("--batch", type=int, default=20)
    events.add_argument("--pause", type=float, default=0.0, help="seconds between files")
    windows = mode("windows", "--source", "--schema", "--at", "--out")
    windows.add_argument("--form", default="json", choices=("json", "parquet"))
    windows.add_argument("--delay", default="1 day", help="how long later events may come")
    windows.add_argument("--size", default="1 hour")
    windows.add_argument("--slide", help="windows begin so far apart; without it, one after the other")
    windows.add_argument("--gap", help="sessions instead: runs of events without a pause of this length")
    windows.add_argument("--by", nargs="*", default=[])
    windows.add_argument("--sum", nargs="*", default=[], help="columns to sum beside the count")
    windows.add_argument("--once", nargs="*", default=[], help="columns that tell events apart: only first copies count")
    windows.add_argument("--console", action="store_true", help="show what is complete, every five seconds, until stopped; nothing is written")
    windows.add_argument("--seconds", type=float, help="stop showing after so long")
    profile = mode("profile", "--curated")
    profile.add_argument("--rows", type=int, default=114_000)
    profile.add_argument("--label", default=LABELS[0])
    for name in ("train", "score", "report", "benchmark", "events"):
        sub.choices[name].add_argument("--experiment", help="runs of this name are kept apart, in a folder of the store")
    a = p.parse_args(argv)
    if a.mode == "train" and (Path(a.results_name).name != a.results_name or a.results_name in (".", "..")):
        p.error("--results-name is a bare file name")
    if a.mode == "events" and len({bool(a.curated), bool(a.key), bool(a.store)}) > 1:
        p.error("--curated, --key and --store go together")
    if getattr(a, "experiment", None):
        if Path(a.experiment).name != a.experiment or a.experiment in (".", ".."):
            p.error("--experiment is a bare name")
        a.store = f"{a.store}/{a.experiment}"
    return a


def _raw(spark, a) -> int:
    from tidemill.sources import files, sinks

    facts = files.scan_csv(spark, a.facts, files.FACT_SCHEMA, corrupt=bool(a.quarantine))
    if a.quarantine:
        found = sinks.keep_corrupt(facts, a.quarantine)
        print(f"good: {found['good']:,}; malformed: {found['bad']:,}")
        facts, expected = sinks.split_corrupt(facts)[0], found["good"]
    else:
        expected = facts.select("MONTH").count()
    sinks.write_partitioned(facts, a.out, "MONTH", a.salt)
    said = sinks.verify_written(spark, a.out, expected)
    print(said)
    return int(not said.startswith("OK"))


def _prepare(spark, a) -> int:
    from pyspark.sql import functions as F

    from tidemill.operators.curate import curate, curation_steps, funnel
    from tidemill.sources import files, sinks

    # What `raw` wrote is read as Parquet; a file or folder of the feed itself as CSV.
    raw = files.scan_facts(spark, a.facts)
    places, carriers = (files.scan_csv(spark, x, infer=True) for x in (a.places, a.carriers))
    for r in funnel(raw, curation_steps()).orderBy("step").collect():
        print(f"{r['name']}: {r['rows']:,}")
    sinks.write_parquet(curate(raw, places, carriers, files.scan_csv(spark, a.code_map) if a.code_map else None), a.out)
    done = spark.read.parquet(a.out).agg(F.count(F.lit(1)).alias("n"), F.avg("label_severe").alias("severe")).first()
    print(f"curated: {done['n']:,}; severe: {100 * (done['severe'] or 0):.2f} %")
    return 0


def _encode_map(spark, a) -> int:
    from pyspark.sql import functions as F

    from tidemill.operators.codemap import code_map
    from tidemill.sources import files, sinks

    places = files.scan_csv(spark, a.places, infer=True).select(F.col("IATA_CODE").alias("iata"), F.col("LATITUDE").cast("double").alias("lat"), F.col("LONGITUDE").cast("double").alias("lon")).na.drop()
    facts = files.scan_facts(spark, a.facts)
    sinks.export_csv(code_map(facts, places, "MONTH", ["AIRLINE", "FLIGHT_NUMBER", "DISTANCE"], "ORIGIN_AIRPORT", "DESTINATION_AIRPORT", "DISTANCE"), a.out, "dot_code")
    return 0


def _train(spark, a) -> int:
    from tidemill.ml.specs import default_specs
    from tidemill.ml.tournament import Settings, register_winner, run_tournament
    from tidemill.ml.tracking import Tracker
    from tidemill.operators.split import SAMPLE, hash_sample
    from tidemill.plans.contract import ServingContract

    curated = spark.read.parquet(a.curated)
    if a.sample_per_mille < 1000:
        curated = hash_sample(curated, a.key, a.sample_per_mille, SAMPLE)
    s = Settings(a.key, a.folds, a.parallelism, a.pca_k, a.tune_per_mille, results_path=f"{a.store}/{a.results_name}", fail_fast=a.fail_fast)
    specs = [x for x in default_specs() if not a.models or x.name in a.models]
    tracker = Tracker(spark, a.store)
    out = run_tournament(curated, specs, tracker, s, a.arms, resume=not a.fresh)
    ServingContract.of(curated, LABELS, out.offset).publish(f"{a.store}/input_schema.json")
    if any(r["task"] == "regression" for r in out.results.values()):
        register_winner(out, tracker)
    return int(bool(out.failures))


def _score(spark, a) -> int:
    from tidemill.ml.tracking import Tracker
    from tidemill.plans.contract import ServingContract
    from tidemill.streaming.score import RowCounter, drain, null_rates, settle, start_scoring

    model, contract = Tracker(spark, a.store).load(a.model, "production", "staging"), ServingContract.load(f"{a.store}/input_schema.json")
    counter = RowCounter()
    spark.streams.addListener(counter)
    try:
        drain(start_scoring(spark, a.source, contract, model, a.out, f"{a.out}/_checkpoint", a.every, a.console, quarantine=a.quarantine), a.seconds)
        settle(spark)
    finally:
        spark.streams.removeListener(counter)
    print(f"rows: {counter.rows:,} in {counter.batches:,} batches")
    missing = null_rates(spark.read.schema(contract.schema).json(a.source)).where("null_rate > 0").orderBy("column")
    for r in missing.collect():  # one row for each column
        print(f"null: {r['column']} {100 * r['null_rate']:.2f} %")
    return int(bool(counter.failures))


def _report(spark, a) -> int:
    from tidemill.ml.report import load_results, markdown_table
    from tidemill.ml.tracking import Tracker

    print(markdown_table(load_results(Tracker(spark, a.store))))
    return 0


def _benchmark(spark, a) -> int:
    from tidemill.ml.report import write_benchmark
    from tidemill.ml.tracking import Tracker
    from tidemill.operators.split import train_test_split

    predicted = None
    if a.curated and a.key:
        model = Tracker(spark, a.store).load("best_pipeline", "production", "staging")
        predicted = model.transform(train_test_split(spark.read.parquet(a.curated), a.key)[1])
    for path in write_benchmark(Tracker(spark, a.store), a.out, predicted, LABELS[0]):
        print(path)
    return 0


def _events(spark, a) -> int:
    from tidemill.plans.contract import ServingContract
    from tidemill.sources.sinks import put_events
    from tidemill.streaming.score import demo_events, held_out_events

    if a.curated:
        rows = held_out_events(spark.read.parquet(a.curated), a.key, ServingContract.load(f"{a.store}/input_schema.json"), a.rows)
    else:
        rows = demo_events(a.rows)
    run = f"{time.time_ns():020d}"
    for k in range(0, len(rows), a.batch):
        if k and a.pause:
            time.sleep(a.pause)
        print(put_events(a.out, f"events-{run}-{k // a.batch:06d}.json", rows[k : k + a.batch]))
    return 0


def _windows(spark, a) -> int:
    from pyspark.sql import functions as F

    from tidemill.streaming import windows as W
    from tidemill.streaming.score import drain, start_console_sink

    when = W.EventTime(a.at, a.delay)
    events = W.scan_events(spark, a.source, a.schema, a.form)
    events = W.first_copies(events, a.once, when) if a.once else W.accepted(events, when)
    totals = {"n": F.count(F.lit(1)), **{f"sum_{c}": F.sum(c) for c in a.sum}}
    out = W.by_session(events, when, a.gap, a.by, totals) if a.gap else W.by_window(events, when, a.size, a.by, totals, a.slide)
    if a.console:
        drain(start_console_sink(out), a.seconds)
        return 0
    W.take_available(out, a.out, f"{a.out}/_checkpoint")
    print(f"complete: {spark.read.parquet(a.out).count():,}")
    return 0


def _profile(spark, a) -> int:
    from tidemill.ml.features import feature_stages
    from tidemill.ml.tournament import profile_stages

    rows = spark.read.parquet(a.curated).limit(a.rows).persist()
    rows.count()
    for name, fit, transform in profile_stages(feature_stages(a.label, False), rows):
        print(f"{name:28s} fit       {fit.line()}")
        print(f"{'':28s} transform {transform.line()}")
    rows.unpersist()
    return 0


MODES = {"raw": _raw, "prepare": _prepare, "encode-map": _encode_map, "train": _train, "score": _score, "report": _report, "benchmark": _benchmark, "events": _events, "windows": _windows, "profile": _profile}


def main(argv: list[str] | None = None) -> int:
    a = _args(sys.argv[1:] if argv is None else argv)
    return MODES[a.mode](build_session(), a)


if __name__ == "__main__":
    sys.exit(main())
