"""Queries of problem 3: written moments as UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.timestamps import normalise_moments
from caseloom.sources.tables import table

#: The one spelling that needs no change.
CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"


def p3_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Every written moment of both tables with its UTC instant, or null."""
    tenants = table(spark, folder, "tenant")
    sent = normalise_moments(table(spark, folder, "inbound_message"), tenants, "message_id", {"sent_at": None})
    orders = normalise_moments(table(spark, folder, "spike_bakery_objects"), tenants, "object_id", {"slot": None, "delivered_at": "slot"})
    return sent.withColumn("table_name", F.lit("inbound_message")).unionByName(orders.withColumn("table_name", F.lit("spike_bakery_objects")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values that name an instant and are not in the canonical spelling yet."""
    rows = p3_moments(spark, folder).where(F.col("utc_us").isNotNull() & ~F.col("raw").rlike(CANONICAL))
    return rows.select("table_name", F.col("row_id").cast("long").alias("row_id"), "field_name", "utc_us")


QUERIES = {"p3_found": p3_found, "p3_moments": p3_moments}
SQL: dict[str, str] = {}
