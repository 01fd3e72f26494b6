"""Sinks."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.files import CORRUPT
from tidemill.sources.store import put_text, replace_text


def write_partitioned(df: DataFrame, path: str, by: str, salt: int = 1) -> None:
    """Parquet by a column's values. salt spreads each value over so many tasks and files."""
    dealt = df.repartition(by) if salt <= 1 else df.repartition(F.col(by), F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
    dealt.write.mode("overwrite").partitionBy(by).parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def verify_written(spark: SparkSession, path: str, expected: int) -> str:
    """OK or MISMATCH: rows found where a table was written against rows expected."""
    found = spark.read.parquet(path).count()
    return f"OK ({found:,} rows)" if found == expected else f"MISMATCH ({found:,} rows, expected {expected:,})"


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that fit their schema, and (record, file) of those that don't, of a scan with corrupt."""
    record = _record(rows)
    # Not a plain test for null: the parser would be given it to filter by, before it knows which records are malformed.
    bad = F.coalesce(F.octet_length(record), F.lit(-1)) >= 0
    return rows.where(~bad).drop(CORRUPT), rows.where(bad).select(record.alias("record"), F.input_file_name().alias("file"))


def _record(rows: DataFrame) -> Column:
    """The malformed record. It names all fields besides (and adds nothing of them), as only fields that are read are parsed."""
    return F.concat(CORRUPT, F.substring(F.concat_ws("", *(F.col(c).cast("string") for c in rows.columns if c != CORRUPT)), 1, 0))


def keep_corrupt(rows: DataFrame, path: str, mode: str = "overwrite") -> dict[str, int]:
    """Writes the records that don't fit to a folder of their own; how many rows fit and how many don't, from one pass."""
    split_corrupt(rows)[1].write.mode(mode).parquet(path)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(_record(rows)).alias("bad")).first()
    return {"good": n["n"] - n["bad"], "bad": n["bad"]}


def export_csv(df: DataFrame, path: str, order: str) -> None:
    """A small table as one sorted CSV file, such as a code map of some hundred rows."""
    df.orderBy(order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def put_json(path: str, value: object) -> None:
    """A JSON file, in any store, that appears whole and may replace one."""
    replace_text(SparkSession.active(), path, json.dumps(value, indent=2, sort_keys=True))


def put_events(folder: str, name: str, rows: Iterable[dict]) -> str:
    """A file of JSON lines that appears whole, so that a stream never reads half of it. The name must be new."""
    put_text(SparkSession.active(), f"{folder}/{name}", "".join(json.dumps(r) + "\n" for r in rows))
    return f"{folder}/{name}"
