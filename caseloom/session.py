"""Session settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """UTC, adaptive execution with skew handling and merged small partitions, Arrow batches of bounded size."""
    return builder.config(map={
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
