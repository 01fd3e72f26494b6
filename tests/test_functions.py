import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import arrow
from tidemill.functions import scalar as S


def one(spark, ddl, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_hhmm(spark):
    rows = [("0005",), ("1430",), ("2400",), ("",), ("x",), (None,), ("0",), ("2359",)]
    assert [r[0] for r in one(spark, "c string", rows, S.hhmm_to_minutes("c"))] == [5, 870, 0, None, None, None, 0, 1439]


def test_haversine_known_route_and_nulls(spark):
    rows = [(47.45, -122.31, 28.43, -81.31), (None, 0.0, 0.0, 0.0), (10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0)]
    got = one(spark, "a double, b double, c double, d double", rows, S.haversine_miles("a", "b", "c", "d"), arrow.haversine_miles_udf("a", "b", "c", "d"))
    assert abs(got[0][0] - 2554) < 5 and got[1] == (None, None) and got[2][0] == 0
    assert abs(got[3][0] - math.pi * S.EARTH_MILES) < 1e-6
    assert all(x is None or abs(x - y) < 1e-6 for x, y in got)


def test_speed_and_detour(spark):
    rows = [(100.0, 30.0, 50.0), (100.0, 0.0, 0.5), (100.0, None, None), (None, 10.0, 1.0)]
    got = one(spark, "d double, m double, g double", rows, S.schedule_speed("d", "m"), S.route_detour("d", "g"), arrow.schedule_speed_udf("d", "m"))
    assert got == [(200.0, 2.0, 200.0), (None, 1.0, None), (None, 1.0, None), (None, 1.0, None)]


def test_clip_takes_null_to_the_lower_fence_and_nan_to_the_upper(spark):
    rows = [(None,), (float("nan"),), (5.0,), (-9.0,), (0.5,)]
    assert [r[0] for r in one(spark, "x double", rows, S.clip("x", -1, 1))] == [-1.0, 1.0, 1.0, -1.0, 0.5]


def test_route_key_skips_nulls(spark):
    assert [r[0] for r in one(spark, "a string, b string", [("A", "B"), (None, "B"), (None, None)], S.route_key("a", "b"))] == ["A-B", "B", ""]


def test_mapped_defaults(spark):
    got = one(spark, "k string", [("a",), ("z",), (None,)], S.mapped("k", {"a": 1.5}, 9.0))
    assert [r[0] for r in got] == [1.5, 9.0, 9.0]


def test_hash_bucket_ignores_partitioning_and_bears_any_key(spark):
    df = spark.createDataFrame([(k,) for k in (0, 1, -5, 2**62, -(2**63))], "k long")
    a = sorted(tuple(r) for r in df.select("k", S.hash_bucket("k")).collect())
    assert a == sorted(tuple(r) for r in df.repartition(3).select("k", S.hash_bucket("k")).collect())
    assert all(0 <= b < 100 for _, b in a)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=20))
def test_signed_log_is_odd_and_monotone(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.signed_log1p("x").alias("y"), S.signed_log1p(-F.col("x")).alias("z"))
    rows = sorted(tuple(r) for r in df.collect())
    assert all(abs(y + z) < 1e-9 and abs(y - math.copysign(math.log1p(abs(x)), x)) < 1e-9 for x, y, z in rows)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(rows, rows[1:], strict=False))


def test_plans_stay_in_codegen(spark):
    df = spark.range(10).select(S.haversine_miles(F.col("id") * 1.0, F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("m"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "*(" in plan


@pytest.mark.parametrize("day,flag", [(1, 0), (5, 0), (6, 1), (7, 1)])
def test_weekend(spark, day, flag):
    assert one(spark, "d int", [(day,)], S.weekend_flag("d"))[0][0] == flag
