"""Views over the driver's tables that give the operators their inputs, for Spark and (as SQL) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import scalar as S


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def geo(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as places with made-up coordinates."""
    k = F.col("n_nationkey")
    return read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("place"), (k * 37 % 121 - 60).cast("double").alias("lat"), (k * 53 % 301 - 150).cast("double").alias("lon"), "n_regionkey")


GEO = "geo AS (SELECT n_nationkey, n_name AS place, CAST(n_nationkey * 37 % 121 - 60 AS DOUBLE) AS lat, CAST(n_nationkey * 53 % 301 - 150 AS DOUBLE) AS lon, n_regionkey FROM nation)"


def ev(spark: SparkSession, sf: str) -> DataFrame:
    """Events as facts: delays, clocks and flags, with nulls and odd values put in by rule."""
    e, k = read(spark, sf, "events"), F.col("event_id")
    clock = F.date_format(F.col("ts").cast("timestamp"), "HHmm")
    return e.select(
        "event_id",
        "user_id",
        F.col("event_type").alias("airline"),
        F.col("value").alias("value"),
        F.when(k % 17 != 0, F.col("value") - 30).alias("delay"),
        F.when(k % 29 == 0, F.lit("2400")).when(k % 31 == 0, F.lit("")).when(k % 37 == 0, F.lit("x")).when(k % 41 != 0, clock).alias("clock"),
        F.when(k % 13 != 0, (k % 11 == 0).cast("int")).alias("cancelled"),
        F.when(k % 19 != 0, F.col("user_id") % 40).alias("place"),
        S.iso_day("ts").alias("dow"),
        F.month("ts").alias("month"),
    )


EV = """ev AS (SELECT event_id, user_id, event_type AS airline, value,
  CASE WHEN event_id % 17 <> 0 THEN value - 30 END AS delay,
  CASE WHEN event_id % 29 = 0 THEN '2400' WHEN event_id % 31 = 0 THEN '' WHEN event_id % 37 = 0 THEN 'x' WHEN event_id % 41 <> 0 THEN strftime(ts, '%H%M') END AS clock,
  CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 11 = 0 AS INTEGER) END AS cancelled,
  CASE WHEN event_id % 19 <> 0 THEN user_id % 40 END AS place,
  CAST(isodow(ts) AS INTEGER) AS dow, CAST(month(ts) AS INTEGER) AS month
FROM events)"""


def legs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as flights from the customer's nation to the supplier's, with their coordinates."""
    g = geo(spark, sf)
    o = g.select(F.col("n_nationkey").alias("c_nationkey"), F.col("place").alias("origin"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    d = g.select(F.col("n_nationkey").alias("s_nationkey"), F.col("place").alias("dest"), F.col("lat").alias("dlat"), F.col("lon").alias("dlon"))
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    cust = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    supp = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    joined = li.join(orders, "l_orderkey").join(cust, "o_custkey").join(supp, "l_suppkey").join(o, "c_nationkey").join(d, "s_nationkey")
    minutes = F.when(F.col("l_orderkey") % 23 == 0, F.lit(0.0)).when(F.col("l_orderkey") % 29 != 0, F.col("l_quantity") * 10)
    return joined.select("l_orderkey", "l_linenumber", "o_custkey", "l_suppkey", "origin", "dest", "olat", "olon", "dlat", "dlon", "l_quantity", minutes.alias("minutes"))


LEGS = (
    GEO
    + """, legs AS (SELECT l_orderkey, l_linenumber, o_custkey, l_suppkey, o.place AS origin, d.place AS dest, o.lat AS olat, o.lon AS olon, d.lat AS dlat, d.lon AS dlon, l_quantity,
  CASE WHEN l_orderkey % 23 = 0 THEN 0.0 WHEN l_orderkey % 29 <> 0 THEN l_quantity * 10 END AS minutes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN geo o ON c_nationkey = o.n_nationkey JOIN geo d ON s_nationkey = d.n_nationkey)"""
)

_HAV = "2 * 3958.7613 * asin(sqrt(least(greatest(pow(sin((radians({c}) - radians({a})) / 2), 2.0) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2.0), 0.0), 1.0)))"
HAV = _HAV.format(a="olat", b="olon", c="dlat", d="dlon")


def drift(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as flights whose place codes are numbers in month 10: from the customer's nation to another one."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.month("o_orderdate").alias("month"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a"), ((F.col("c_nationkey") * 7 + 3) % 25).alias("b"))
    g = geo(spark, sf)
    x = g.select(F.col("n_nationkey").alias("a"), F.col("place").alias("an"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    y = g.select(F.col("n_nationkey").alias("b"), F.col("place").alias("bn"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    code = lambda k, n: F.when(F.col("month") == 10, (F.col(k) + 10000).cast("string")).otherwise(F.col(n))
    joined = o.join(c, "o_custkey").join(x, "a").join(y, "b")
    dist = F.round(S.haversine_miles("alat", "alon", "blat", "blon"))
    return joined.select("o_orderkey", "o_custkey", "month", code("a", "an").alias("origin"), code("b", "bn").alias("dest"), dist.alias("distance"))


DRIFT = (
    GEO
    + ", drift AS (SELECT o_orderkey, o_custkey, CAST(month(o_orderdate) AS INTEGER) AS month, "
    + "CASE WHEN month(o_orderdate) = 10 THEN CAST(10000 + x.n_nationkey AS VARCHAR) ELSE x.place END AS origin, "
    + "CASE WHEN month(o_orderdate) = 10 THEN CAST(10000 + y.n_nationkey AS VARCHAR) ELSE y.place END AS dest, "
    + f"round({_HAV.format(a='x.lat', b='x.lon', c='y.lat', d='y.lon')}) AS distance "
    + "FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo x ON c_nationkey = x.n_nationkey JOIN geo y ON (c_nationkey * 7 + 3) % 25 = y.n_nationkey)"
)
