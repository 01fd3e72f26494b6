"""Shared plumbing: shared storage, lineage cuts, bounded Arrow batches, zlib digests."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch; whole texts of that many rows are in a Python worker at once.
BATCH_ROWS = 512
#: Bytes of one Arrow batch; a single text may be longer.
BATCH_BYTES = 16 << 20
#: Tables of keys up to this many bytes, as counted, are broadcast; longer ones are joined by a shuffle.
KEY_BYTES, ROW_BYTES = 32 << 20, 128


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Holds Arrow batches to a number of rows, and of bytes, that a worker with long texts can bear.

    Plans read the settings when they run, so they stay; smaller ones that a caller has set are left alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, str(-1)):
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a local
    one, but only if the executors are on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemill-"))
    return sc.getCheckpointDir()


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, by a reliable checkpoint in the shared folder."""
    shared_dir(session(df))
    return df.checkpoint(eager=True)


def restrict(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join with a cut table of short keys, which is sent to all executors only if its counted size allows it."""
    small = keys.count() * ROW_BYTES <= KEY_BYTES
    return df.join(F.broadcast(keys) if small else keys, on, how)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that a run has made in the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def binary(column: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def _rank_bucket(column: str) -> Column:
    """A bucket, rising with the hash of a column, that tells hashes apart to one part in 64 at any size."""
    u = F.shiftrightunsigned(F.xxhash64(column), 1)
    bits = F.length(F.bin(u))
    return bits * 64 + F.when(bits > 7, F.call_function("shiftright", u, bits - 7).bitwiseAND(63)).otherwise(F.lit(0)).cast("int")


def bounded_sample(df: DataFrame, group: str, key: str, rows: int) -> DataFrame:
    """The rows of each group with the least hashes of a key, so many at most (all ties of the first bucket, if it has more).

    One count by group and bucket gives each group its last bucket; the rows meet these in a join. No group is gathered
    anywhere, and there may be any number of them. Rows without a group, or a key, are left out.
    """
    bucket = _rank_bucket(key)
    counts = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), bucket.alias("b")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("g").orderBy("b")  # some hundred buckets
    upto = counts.withColumns({"upto": F.sum("n").over(order), "first": F.row_number().over(order) == 1})
    last = cut(upto.where(F.col("first") | (F.col("upto") <= rows)).groupBy("g").agg(F.max("b").alias("last")))
    named = df.select(F.struct("*").alias("row"), F.col(group).alias("g"), bucket.alias("b"))
    return restrict(named, last, ["g"], "inner").where("b <= last").select("row.*")


def filtered(docs: DataFrame, text_col: str, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows of which keep says so, by their texts (null: empty). One pass: each row is judged by itself, whatever
    its id, nothing is shuffled, and all columns stay."""
    bounded_batches(session(docs))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def crc_mod4(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def ids_crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4")) & 0xFFFFFFFF


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of (id, bytes) from batches whose first two columns these are."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
