"""A curated table in the full shape of the feature chain, made from the driver's tables by rule."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import scalar as S
from tidemill.ml.features import feature_stages
from tidemill.ml.stages import HeldRows
from tidemill.operators.split import train_test_split
from tidemill.plans.views import legs


def flights(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as flights: all columns of the serving contract, a delay that follows from them, and a row id."""
    d = legs(spark, sf)
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    noise = lambda n, salt: (F.pmod(F.xxhash64(key, "l_suppkey", F.lit(salt)), F.lit(n))).cast("int")
    miles = S.haversine_miles("olat", "olon", "dlat", "dlon")
    minute = noise(1440, 1)
    delay = F.when(noise(50, 2) == 0, 60 + noise(800, 3)).otherwise(noise(37, 4) - 12)
    taxi = 8 + noise(20, 5)
    clock = F.lpad((F.floor(minute / 60) * 100 + minute % 60).cast("string"), 4, "0")
    base = d.where("olat is not null and dlat is not null").select(
        F.xxhash64(key, "l_suppkey", "l_quantity").alias("row_id"),
        (noise(12, 6) + 1).alias("MONTH"),
        (noise(28, 7) + 1).alias("DAY"),
        (noise(7, 8) + 1).alias("DAY_OF_WEEK"),
        F.concat(F.lit("A"), noise(14, 9).cast("string")).alias("AIRLINE"),
        F.col("origin").alias("ORIGIN_AIRPORT"),
        F.col("dest").alias("DESTINATION_AIRPORT"),
        clock.alias("SCHEDULED_DEPARTURE"),
        delay.alias("DEPARTURE_DELAY"),
        taxi.alias("TAXI_OUT"),
        F.round(miles * (1 + noise(100, 10) / 1000)).cast("int").alias("DISTANCE"),
        F.round(30 + miles / 8 + noise(15, 11)).cast("int").alias("SCHEDULED_TIME"),
        F.col("olat").alias("ORIGIN_LAT"),
        F.col("olon").alias("ORIGIN_LON"),
        F.col("dlat").alias("DEST_LAT"),
        F.col("dlon").alias("DEST_LON"),
        (noise(19, 12) - 9).alias("__noise"),
    )
    dep = S.hhmm_to_minutes("SCHEDULED_DEPARTURE")
    arrival = F.col("DEPARTURE_DELAY") * 0.95 + (F.col("TAXI_OUT") - 16) * 0.8 + F.col("__noise")
    return base.withColumns(
        {
            "SCHED_DEP_MIN": dep,
            "SCHED_ARR_MIN": (dep + F.col("SCHEDULED_TIME")) % 1440,
            "WHEELS_OFF_MIN": F.pmod(dep + F.col("DEPARTURE_DELAY") + F.col("TAXI_OUT"), F.lit(1440)),
            "DEP_HOUR": S.hour_of(dep),
            "IS_WEEKEND": S.weekend_flag("DAY_OF_WEEK"),
            "ROUTE": S.route_key("ORIGIN_AIRPORT", "DESTINATION_AIRPORT"),
            "label_delay": arrival,
            "label_severe": (arrival > 30).cast("double"),
        }
    ).drop("__noise")


def fit_chain(train: DataFrame, use_pca: bool = False) -> PipelineModel:
    """The whole default chain with a linear model; what the fit held in memory is let go."""
    with HeldRows() as held:
        est = LinearRegression(featuresCol="features", labelCol="label_delay", maxIter=50, regParam=0.01)
        return Pipeline(stages=[*feature_stages("label_delay", use_pca, held=held), est]).fit(train)


def chain_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The default chain fitted to the training part and measured on the rest: rmse, mae, r2."""
    from tidemill.operators.metrics import regression_metrics

    train, test = train_test_split(flights(spark, sf), "row_id")
    return regression_metrics(fit_chain(train).transform(test), "label_delay", "prediction")
