"""Sinks: write-once stores, register files, label sheets and merge-safe writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.logs import insert_if_absent


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(p)


#: Buckets of a write-once store; a batch reads only those that its keys fall in.
BUCKETS = 64


def append_absent(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], batch: str | None = None) -> None:
    """Appends the rows whose key the store lacks, each key once; running it again appends nothing.

    The store is partitioned by bucket of the key and by batch. A batch reads the
    buckets of its own keys only, without what an earlier, broken attempt of the
    same ``batch`` left, and replaces that; so a retried batch writes the same
    rows once. A store has one writer at a time.
    """
    spark = df.sparkSession
    mine = batch or uuid.uuid4().hex
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    if _exists(df, path):
        touched = [r[0] for r in bucketed.select("_bucket").distinct().collect()]  # at most BUCKETS rows
        stored = spark.read.parquet(path).where(F.col("_bucket").isin(touched) & (F.col("_batch").cast("string") != mine))
    else:
        stored = bucketed.where(F.lit(False))
    new = insert_if_absent(stored, bucketed, keys, order).withColumn("_batch", F.lit(mine))
    new.select(*df.columns, "_bucket", "_batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_batch").parquet(path)


def append_only(df: DataFrame, path: str) -> None:
    """Adds rows to a log. There is no way here to change or remove what a log has; a path that holds another schema is refused."""
    if _exists(df, path) and (known := df.sparkSession.read.parquet(path).columns) != df.columns:
        raise ValueError(f"the log has columns {known}")
    df.write.mode("append").parquet(path)


def rebuild(df: DataFrame, path: str, by: str = "tenant_id", scope: Sequence[object] | None = None) -> None:
    """Replaces a projection: the whole store, or only the partitions in ``scope``, and of these also such as ``df`` has no rows for any more."""
    if scope is None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)
        return
    own = df.where(F.col(by).isin(*scope))
    full = {r[0] for r in own.select(by).distinct().collect()}  # at most the scope
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    jvm = df.sparkSession._jvm
    for gone in [x for x in scope if x not in full]:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={gone}")
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def write_register(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """The register as CSV with a header, in order."""
    df.orderBy(*order).select(*columns).write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def label_sheet(rows: DataFrame, existing: DataFrame, key: str, labels: Sequence[str]) -> DataFrame:
    """Rows with empty label columns, but for labels that exist already."""
    old = existing.select(key, *labels)
    return rows.join(old, key, "left").select(*rows.columns, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in labels])
