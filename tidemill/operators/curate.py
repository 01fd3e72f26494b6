"""From raw facts to the curated table: repair, filter, enrich, derive, label, drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import scalar as S

#: Reference tables up to so many bytes by their own statistics are sent to every executor; larger ones are joined by key.
SMALL_BYTES = 64 << 20


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """Asks for a broadcast if the plan's own size estimate is at most the given bytes, else leaves the join to the planner."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def repair_codes(df: DataFrame, code_map: DataFrame, columns: Sequence[str], code: str = "dot_code", good: str = "iata_code") -> DataFrame:
    """Replaces codes that the map knows in each column; others stay as they are. One row in, one row out: of several
    meanings of a code the least counts."""
    for c in columns:
        names = code_map.groupBy(F.col(code).alias(f"__code_{c}")).agg(F.min(good).alias(f"__good_{c}"))
        df = df.join(small(names), F.col(c) == F.col(f"__code_{c}"), "left").withColumn(c, F.coalesce(f"__good_{c}", c)).drop(f"__code_{c}", f"__good_{c}")
    return df


def completed(df: DataFrame, flags: Sequence[str] = ("CANCELLED", "DIVERTED"), present: Sequence[str] = ("ARRIVAL_DELAY", "DEPARTURE_DELAY", "TAXI_OUT")) -> DataFrame:
    """Rows whose flags are zero (a null flag drops the row) and whose needed columns aren't null."""
    for c in flags:
        df = df.where(F.col(c) == 0)
    for c in present:
        df = df.where(F.col(c).isNotNull())
    return df


def enrich_places(df: DataFrame, places: DataFrame, roles: dict[str, tuple[str, str]], key: str = "IATA_CODE", lat: str = "LATITUDE", lon: str = "LONGITUDE") -> DataFrame:
    """Coordinates of the same dimension in several roles: {fact column: (latitude column, longitude column)}."""
    for c, (to_lat, to_lon) in roles.items():
        dim = places.select(F.col(key).alias(f"__{c}"), F.col(lat).cast("double").alias(to_lat), F.col(lon).cast("double").alias(to_lon))
        df = df.join(small(dim), F.col(c) == F.col(f"__{c}"), "left").drop(f"__{c}")
    return df


def enrich_names(df: DataFrame, names: DataFrame, column: str = "AIRLINE", key: str = "IATA_CODE", name: str = "AIRLINE", to: str = "AIRLINE_NAME") -> DataFrame:
    dim = names.select(F.col(key).alias("__key"), F.col(name).alias(to))
    return df.join(small(dim), F.col(column) == F.col("__key"), "left").drop("__key")


def derive(df: DataFrame) -> DataFrame:
    """Clock and route features of the fact feed, in one projection."""
    dep = S.hhmm_to_minutes("SCHEDULED_DEPARTURE")
    return df.withColumns(
        {
            "SCHED_DEP_MIN": dep,
            "SCHED_ARR_MIN": S.hhmm_to_minutes("SCHEDULED_ARRIVAL"),
            "WHEELS_OFF_MIN": S.hhmm_to_minutes("WHEELS_OFF"),
            "DEP_HOUR": S.hour_of(dep),
            "IS_WEEKEND": S.weekend_flag("DAY_OF_WEEK"),
            "ROUTE": S.route_key("ORIGIN_AIRPORT", "DESTINATION_AIRPORT"),
            "label_delay": F.col("ARRIVAL_DELAY").cast("double"),
            "label_severe": S.severe_label("ARRIVAL_DELAY"),
        }
    )


def curation_steps() -> list[tuple[str, Column]]:
    """What a row of the feed must pass, one condition after another."""
    flags, needed = ("CANCELLED", "DIVERTED"), ("ARRIVAL_DELAY", "DEPARTURE_DELAY", "TAXI_OUT")
    return [*((f"not {c.lower()}", F.col(c) == 0) for c in flags), *((f"has {c.lower()}", F.col(c).isNotNull()) for c in needed)]


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that pass the first k conditions, for each k, in one pass: (step, name, rows)."""
    passed, sums = F.lit(True), [F.count(F.lit(1)).alias("c0")]
    for k, (_, condition) in enumerate(steps, 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        sums.append(F.sum(passed.cast("long")).alias(f"c{k}"))
    names = ["all", *(n for n, _ in steps)]
    rows = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(n).alias("name"), F.coalesce(f"c{k}", F.lit(0)).cast("long").alias("rows")) for k, n in enumerate(names)))
    return df.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def curate(raw: DataFrame, places: DataFrame, carriers: DataFrame, code_map: DataFrame | None = None) -> DataFrame:
    """The curated table: one lazy plan of narrow steps and reference joins; only the write runs it."""
    from tidemill.plans.contract import LeakagePolicy

    df = completed(raw)
    if code_map is not None:
        df = repair_codes(df, code_map, ("ORIGIN_AIRPORT", "DESTINATION_AIRPORT"))
    df = enrich_places(df, places, {"ORIGIN_AIRPORT": ("ORIGIN_LAT", "ORIGIN_LON"), "DESTINATION_AIRPORT": ("DEST_LAT", "DEST_LON")})
    df = derive(enrich_names(df, carriers))
    df = df.where(" and ".join(f"{c} is not null" for c in ("ORIGIN_LAT", "ORIGIN_LON", "DEST_LAT", "DEST_LON")))
    return LeakagePolicy().drop(df)
