"""Session factory."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

#: Settings that hold for every session made here; they need no particular machine.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.driver.maxResultSize": "2g",
}


def build_session(app: str = "tidemill", cores: str = "*", driver_memory: str = "8g", shuffle_partitions: int | None = None, master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """The active session if there is one (it keeps its own settings), else a new one."""
    if (active := SparkSession.getActiveSession()) is not None:
        return active
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    os.environ.setdefault("PYSPARK_SUBMIT_ARGS", f"--driver-memory {driver_memory} pyspark-shell")
    builder = SparkSession.builder.appName(app)
    if master or "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.master(master or f"local[{cores}]")
    conf = DEFAULTS | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | (extra or {})
    return builder.config(map=conf).getOrCreate()
