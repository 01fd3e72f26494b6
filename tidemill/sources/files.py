"""Scans."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.store import get_text

#: The fact feed's columns, in file order. Clock columns are text, as leading zeros count.
FACT_COLUMNS = (
    "YEAR MONTH DAY DAY_OF_WEEK AIRLINE FLIGHT_NUMBER TAIL_NUMBER ORIGIN_AIRPORT DESTINATION_AIRPORT SCHEDULED_DEPARTURE DEPARTURE_TIME "
    "DEPARTURE_DELAY TAXI_OUT WHEELS_OFF SCHEDULED_TIME ELAPSED_TIME AIR_TIME DISTANCE WHEELS_ON TAXI_IN SCHEDULED_ARRIVAL ARRIVAL_TIME ARRIVAL_DELAY "
    "DIVERTED CANCELLED CANCELLATION_REASON AIR_SYSTEM_DELAY SECURITY_DELAY AIRLINE_DELAY LATE_AIRCRAFT_DELAY WEATHER_DELAY"
).split()
FACT_TEXT = frozenset(
    "AIRLINE TAIL_NUMBER ORIGIN_AIRPORT DESTINATION_AIRPORT CANCELLATION_REASON SCHEDULED_DEPARTURE DEPARTURE_TIME WHEELS_OFF WHEELS_ON SCHEDULED_ARRIVAL ARRIVAL_TIME".split()
)
FACT_SCHEMA = T.StructType([T.StructField(c, T.StringType() if c in FACT_TEXT else T.IntegerType()) for c in FACT_COLUMNS])


#: The column that holds a record that doesn't fit its schema, whole; null for records that do.
CORRUPT = "_corrupt_record"


def with_corrupt(schema: T.StructType | str) -> T.StructType:
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, infer: bool = False, header: bool = True, corrupt: bool = False) -> DataFrame:
    """CSV, with a header. With a schema, malformed fields are null; without, all text unless infer is set.

    With corrupt, a record that doesn't fit its schema (a field of another type, too few or too many fields) is there
    whole in the column CORRUPT. All fields are then parsed, whichever are read, so that a record is the same to all readers.
    """
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if corrupt:
        if schema is None:
            raise ValueError("malformed records are those that don't fit a schema")
        schema, reader = with_corrupt(schema), reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", infer)).csv(path)


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def scan_facts(spark: SparkSession, path: str) -> DataFrame:
    """The fact feed: CSV, or the Parquet that was made of it (with the partition column back in its place)."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return scan_csv(spark, path, FACT_SCHEMA)
    return spark.read.parquet(path).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in FACT_SCHEMA.fields))


def scan_json_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1, corrupt: bool = False) -> DataFrame:
    """A folder of JSON lines as a stream. Fields that don't fit the schema are null; with corrupt, the whole line of such
    a record is in the column CORRUPT."""
    return spark.readStream.schema(with_corrupt(schema) if corrupt else schema).option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", files_per_trigger).option("mode", "PERMISSIVE").json(path)


def find_source(name: str, env: str = "TIDEMILL_RAW_DIR", folders: Sequence[str] = ("data", "../data_raw")) -> str:
    """The first place that has the file: the folder an environment variable names, then the given ones."""
    tried = [Path(d) / name for d in (*([os.environ[env]] if os.environ.get(env) else []), *folders)]
    for p in tried:
        if p.exists():
            return str(p)
    raise FileNotFoundError(f"{name} is in none of: " + ", ".join(map(str, tried)))


def read_json(path: str) -> dict | list:
    """A JSON file in any store."""
    return json.loads(get_text(SparkSession.active(), path))
