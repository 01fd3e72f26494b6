"""Small files in whatever store a path names, written whole; on the driver only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Under another name first, then moved: a reader sees the whole file or none. The name must be new."""
    put_bytes(spark, path, text.encode())


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, target = _open(spark, path)
    _, part = _open(spark, f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if not fs.rename(part, target):
        raise OSError(f"could not move a file to {path}")


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """The same for a name that may be there already: readers see the old file or the new one."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs, target = _open(spark, path)
    new = f"{path}.{uuid.uuid4().hex}"
    put_text(spark, new, text)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    whole = fs.makeQualified(target)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(_open(spark, new)[1]), whole, how)


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir. Where that is unset, as in tests, a
    local one, but only if the executors are on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=f"tidemill-{what}-")
