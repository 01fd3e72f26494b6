"""Schema contracts: what training publishes and serving enforces, and the leakage policy."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemill.sources.files import read_json
from tidemill.sources.sinks import put_json

#: Columns known only after the event, and the threshold of a severe delay in minutes.
LEAKY_COLUMNS = (
    "ARRIVAL_DELAY ARRIVAL_TIME ELAPSED_TIME AIR_TIME WHEELS_ON TAXI_IN AIR_SYSTEM_DELAY SECURITY_DELAY AIRLINE_DELAY LATE_AIRCRAFT_DELAY WEATHER_DELAY "
    "CANCELLED CANCELLATION_REASON DIVERTED YEAR"
).split()
ALLOWED_RAW = (
    "MONTH DAY DAY_OF_WEEK AIRLINE FLIGHT_NUMBER TAIL_NUMBER ORIGIN_AIRPORT DESTINATION_AIRPORT SCHEDULED_DEPARTURE DEPARTURE_TIME DEPARTURE_DELAY TAXI_OUT "
    "WHEELS_OFF SCHEDULED_TIME DISTANCE SCHEDULED_ARRIVAL"
).split()
SEVERE_MINUTES = 30


@dataclass(frozen=True)
class LeakagePolicy:
    """Columns that must not reach a model, and the raw columns that may."""

    leaky: tuple[str, ...] = tuple(LEAKY_COLUMNS)
    allowed: tuple[str, ...] = tuple(ALLOWED_RAW)

    def drop(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c in self.leaky])

    def check(self, df: DataFrame, derived: Iterable[str] = (), labels: Iterable[str] = ()) -> None:
        """Raises unless every column is allowed, derived or a label. A new raw column fails by default."""
        known = {*self.allowed, *derived, *labels}
        if bad := [c for c in df.columns if c in self.leaky or c not in known]:
            raise ValueError(f"columns outside the policy: {bad}")


@dataclass(frozen=True)
class ServingContract:
    """Column names and types that scoring accepts, and the label shift that training used."""

    schema: T.StructType
    glm_offset: float = 0.0
    labels: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, df: DataFrame, labels: Iterable[str], glm_offset: float = 0.0) -> ServingContract:
        labels = tuple(labels)
        return cls(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields if f.name not in labels]), glm_offset, labels)

    def publish(self, path: str) -> None:
        put_json(path, {"fields": [{"name": f.name, "type": f.dataType.simpleString()} for f in self.schema.fields], "glm_offset": self.glm_offset})

    @classmethod
    def load(cls, path: str) -> ServingContract:
        """Any type that a schema string can name is accepted."""
        try:
            raw = read_json(path)
        except FileNotFoundError as e:
            raise FileNotFoundError(f"no serving contract at {path}; training publishes it") from e
        fields = ", ".join(f"`{f['name']}` {f['type']}" for f in raw["fields"])
        return cls(T.StructType([T.StructField(f.name, f.dataType, True) for f in T.StructType.fromDDL(fields).fields]), float(raw.get("glm_offset", 0.0)))
