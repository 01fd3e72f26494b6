"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import fresh_folder, remove_folder
from tidemill.llm.decontam import drop_contaminated
from tidemill.llm.exact import drop_exact
from tidemill.llm.neardup import drop_near
from tidemill.llm.packing import pack
from tidemill.llm.quality import keep_good
from tidemill.llm.tokens import public_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network rejects (probability under a half) go. Each row is judged by itself, ids don't matter."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays, a null id counting as the smallest."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8 or more) the one with the least id stays, a null id coming last."""
    return drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Each row is judged by itself, ids don't matter."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 ids; a repeated id is packed as often as it has rows."""
    return pack(docs, public_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pack", packed)]

#: The quality network can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet, read by the next, and deleted after that.

    The last folder is the input of the result and stays. Empty tables give no rows; other columns are kept up to packing.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        folder = fresh_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
