"""Column functions. All of them stay in whole-stage code generation; none needs Python on executors."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in miles.
EARTH_MILES = 3958.7613
MINUTES_OF_DAY = 1440
#: Odd factors by salt; their products with what they multiply stay within 63 bits.
SALT_FACTORS = (2246822519, 3266489917, 668265263, 374761393)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hhmm_to_minutes(c: Column | str) -> Column:
    """Minutes after midnight of a clock string like '0005' or '1430'; '2400' is 0. Not a number: null."""
    v = F.expr("try_cast({} as int)".format(_quoted(c))) if isinstance(c, str) else c.try_cast("int")
    return (F.floor(v / F.lit(100)).cast("int") % 24) * 60 + v % 100


def _quoted(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.replace("`", "").split("."))


def hour_of(minutes: Column | str) -> Column:
    return F.floor(_col(minutes) / 60).cast("int")


def weekend_flag(day_of_week: Column | str) -> Column:
    """1 for days 6 and 7 of a week that starts with Monday as 1."""
    return _col(day_of_week).isin(6, 7).cast("int")


def iso_day(ts: Column | str) -> Column:
    return F.weekday(_col(ts)) + 1


def route_key(origin: Column | str, dest: Column | str) -> Column:
    """'origin-dest'; a null end is left out together with the dash."""
    return F.concat_ws("-", _col(origin), _col(dest))


def haversine_miles(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    """Great-circle distance; null if any coordinate is null."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2.0))
    # least and greatest skip nulls, so the null of a coordinate is kept outside them.
    return F.when(h.isNotNull(), 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))))


def schedule_speed(distance: Column | str, minutes: Column | str) -> Column:
    """Miles an hour; null unless minutes are positive."""
    m = _col(minutes).cast("double")
    return F.when(m > 0, _col(distance).cast("double") / (m / 60.0))


def route_detour(distance: Column | str, great_circle: Column | str) -> Column:
    """Flown over great-circle distance; 1 where the latter is null or at most a mile."""
    gc = _col(great_circle)
    return F.when(gc > 1, _col(distance) / gc).otherwise(F.lit(1.0))


def signed_log1p(c: Column | str) -> Column:
    x = _col(c).cast("double")
    return F.signum(x) * F.log1p(F.abs(x))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Within the fences; a null becomes the lower fence and NaN the upper one, as least and greatest have it."""
    return F.least(F.greatest(_col(c).cast("double"), F.lit(float(low))), F.lit(float(high)))


def severe_label(delay: Column | str, threshold: float = 30) -> Column:
    return (_col(delay) > threshold).cast("double")


#: Entries of each part of a lookup literal, about.
PART = 8


def mapped(c: Column | str, table: dict[str, float], default: float) -> Column:
    """A learned lookup as one literal, parsed once: maps by checksum of the key, so that a row is held against some
    eight keys, however many there are. Missing and null keys: the default."""
    key = _col(c).cast("string")
    parts: list[dict[str, float]] = [{} for _ in range(len(table) // PART + 1)]
    for k, v in table.items():
        parts[zlib.crc32(k.encode()) % len(parts)][k] = v
    literal = F.from_json(F.lit(json.dumps(parts)), "array<map<string,double>>")
    part = F.element_at(literal, (F.crc32(key.cast("binary")) % len(parts) + 1).cast("int")) if len(parts) > 1 else literal[0]
    return F.coalesce(F.try_element_at(part, key), F.lit(float(default)))


def hash_bucket(key: Column | str, buckets: int = 100, salt: int = 0) -> Column:
    """A bucket from an integer key by arithmetic alone: the same on any partitioning and in any SQL engine.

    The key is reduced before it is multiplied, so that no key overflows. Each salt has a factor of its
    own, so that its buckets don't go with those of another, for a choice within a choice.
    """
    n = lambda v: F.lit(v).cast("long")
    h = F.pmod(F.pmod(_col(key).cast("long"), n(1 << 31)) * n(2654435761), n(1 << 32))
    if salt:
        mixed = (h % n(1 << 16)) * n(40503) + F.floor(h / n(1 << 16)).cast("long") + n(7919 * salt)
        h = F.floor(F.pmod(mixed * n(SALT_FACTORS[salt % len(SALT_FACTORS)]), n(1 << 32)) / n(64)).cast("long")
    return h % buckets
