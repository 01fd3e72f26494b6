"""Event time on streams: repeated events, tumbling, sliding and session windows, joins in time, all with a watermark."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.files import scan_json_stream
from tidemill.streaming.score import drain, start_parquet_sink


@dataclass(frozen=True)
class EventTime:
    """The column that says when an event happened, and how long later rows may come.

    The watermark is the latest time seen in the batches before, less the delay. A row at or before it, or of a window
    that has ended by then, is left out; state that no accepted row can need any more is let go, so state is bounded by
    the events of a delay (and of a window, a gap or a span), not by the stream.
    """

    column: str = "ts"
    delay: str = "1 day"


def scan_events(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """A folder as a stream, of JSON lines (fields that don't fit are null) or of Parquet."""
    if form == "json":
        kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return scan_json_stream(spark, path, kind, files_per_trigger or 1000)
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).format(form).load(path)


def accepted(events: DataFrame, when: EventTime) -> DataFrame:
    """The events with their watermark; those without a time are left out, as they belong nowhere."""
    return events.where(F.col(when.column).isNotNull()).withWatermark(when.column, when.delay)


def first_copies(events: DataFrame, keys: Sequence[str], when: EventTime) -> DataFrame:
    """The first copy of each event, by keys; copies that come within the delay are known by their state."""
    return accepted(events, when).dropDuplicatesWithinWatermark(list(keys))


def by_window(events: DataFrame, when: EventTime, size: str, by: Sequence[str], totals: dict[str, Column], slide: str | None = None) -> DataFrame:
    """begins, ends, keys and totals of each window, tumbling or (with a slide) sliding, once it is complete.

    events: as accepted or first_copies returns them.
    """
    at = F.window(F.col(when.column), size, slide) if slide else F.window(F.col(when.column), size)
    return events.groupBy(at.alias("w"), *by).agg(*(c.alias(n) for n, c in totals.items())).select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), *by, *totals)


def by_session(events: DataFrame, when: EventTime, gap: str, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """The same for sessions: runs of events of a key, none a gap or more after the one before; they end a gap after the last."""
    return events.groupBy(F.session_window(F.col(when.column), gap).alias("w"), *by).agg(*(c.alias(n) for n, c in totals.items())).select(F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), *by, *totals)


def followed_by(first: DataFrame, then: DataFrame, key: str, when: EventTime, span: str, names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Pairs of an event and a later one of the same key at most a span after it; columns get a prefix of their side.

    Both sides keep what may still find a partner: a span and a delay's worth of events.
    """
    a, b = (accepted(d, when).select(*(F.col(c).alias(f"{n}_{c}") for c in d.columns)) for d, n in zip((first, then), names, strict=True))
    t, u = (F.col(f"{n}_{when.column}") for n in names)
    same = F.col(f"{names[0]}_{key}") == F.col(f"{names[1]}_{key}")
    return a.join(b, same & (u >= t) & (u <= t + F.expr(f"INTERVAL {span}")))


def take_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes what is complete to Parquet, and ends; a later call with the same checkpoint goes on from there.

    The sink's log has each batch once, so a run that was broken off, or repeated, writes no row twice.
    """
    drain(start_parquet_sink(stream, out, checkpoint))
