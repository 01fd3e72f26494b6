"""Splits that don't depend on how rows are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.scalar import hash_bucket


def train_test_split(df: DataFrame, key: str, train_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """By a hash of an integer key; rows of a null key are in the test part."""
    learn = F.coalesce(hash_bucket(key) < train_percent, F.lit(False))
    return df.where(learn), df.where(~learn)


def with_folds(df: DataFrame, key: str, folds: int, column: str = "fold") -> DataFrame:
    """A fold number for each row, independent of the split and of the sample."""
    return df.withColumn(column, hash_bucket(key, folds, salt=1).cast("int"))


#: Salts of the choices that must not go together: folds have 1.
TUNING, SAMPLE = 2, 3


def hash_sample(df: DataFrame, key: str, per_mille: int, salt: int = TUNING) -> DataFrame:
    """So many in a thousand rows, by a hash of the key; samples of different salts are independent."""
    return df.where(hash_bucket(key, 1000, salt=salt) < per_mille)
