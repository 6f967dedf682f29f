"""Decisions that depend on the size of data: broadcasts and partition numbers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if the optimizer bounds its size by this.
BROADCAST_BYTES = 64 << 20


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's bound of the size of a frame, from file sizes and the plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its planned size is within ``limit``, else as it is, for a shuffled join."""
    return F.broadcast(df) if planned_bytes(df) <= limit else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and with its lineage cut: a table written to the shared folder, which survives the loss of executors.

    The folder is read from ``spark.checkpoint.dir``; only where that is unset
    (tests, a single machine) one is made under the system's temporary folder,
    and removed at the end. A checkpoint would compute the frame twice.
    """
    spark = df.sparkSession
    path = f"{_work_folder(spark)}/caseloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _work_folder(spark: SparkSession) -> str:
    global _local_folder
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="caseloom-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


_local_folder: str | None = None


def cores(df: DataFrame, tasks_per_core: int = 4) -> int:
    """Number of tasks that keeps every core busy."""
    return df.sparkSession.sparkContext.defaultParallelism * tasks_per_core


def spread(scan: DataFrame, tasks_per_core: int = 4) -> DataFrame:
    """A scan in enough partitions to keep every core busy with work that costs far more than reading.

    Few or large files give few tasks; then the rows are dealt out in one
    exchange, which also evens out a partition of long texts. Otherwise the frame
    stays as it is. Only for frames without an exchange: asking another for its
    partitions would run it; repartition that to :func:`cores`.
    """
    want = cores(scan, tasks_per_core)
    return scan if scan.rdd.getNumPartitions() >= want else scan.repartition(want)
