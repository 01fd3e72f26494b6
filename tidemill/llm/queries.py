"""The opN_ queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import pipeline
from tidemill.llm.centroids import cluster_report, cluster_sql
from tidemill.llm.collocations import collocations, collocations_sql
from tidemill.llm.decontam import contamination
from tidemill.llm.exact import exact_dedup
from tidemill.llm.language import language_report
from tidemill.llm.mixing import mix_report
from tidemill.llm.packing import pack
from tidemill.llm.pages import extract_pages
from tidemill.llm.pii import pii_digest
from tidemill.llm.quality import quality_report
from tidemill.llm.repeats import remove_repeats
from tidemill.llm.shards import encode_corpus
from tidemill.llm.simhash import simhash_components
from tidemill.llm.tokens import public_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_read(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_read(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"), with_text=False)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(_read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_read(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(_read(spark, sf_dir, "embeddings"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {f.__name__: f for f in (op1_simhash, op2_token_shards, op3_repeats, op4_language, op5_exact_dedup, op6_main_text, op7_packing, op8_quality, op9_pii, op10_decontamination, op11_mix, op12_collocations, op13_centroids)}
    return {**named, "pipeline": pipeline.run}


_OP5 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def llm_oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": _OP5, "op12_collocations": collocations_sql(), "op13_centroids": cluster_sql()} | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
