"""Normalisation of written moments to UTC instants."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions import instants
from caseloom.plans.sizing import broadcast_if_small


@F.pandas_udf(T.LongType())
def _instant(value: pd.Series, zone: pd.Series, order: pd.Series) -> pd.Series:
    return instants.parse(value, zone, order)


@F.pandas_udf(T.LongType())
def _instant_near(value: pd.Series, zone: pd.Series, order: pd.Series, anchor: pd.Series) -> pd.Series:
    return instants.parse(value, zone, order, anchor)


def utc_micros(value: Column, zone: Column, order: Column, anchor: Column | None = None) -> Column:
    """UTC microseconds of a written moment.

    Null, empty, impossible and meaningless values give null. A value without an
    offset is wall-clock time in ``zone``; without a known zone it gives null. A
    bare time of day takes the local date of ``anchor`` (microseconds), else null.
    """
    return _instant(value, zone, order) if anchor is None else _instant_near(value, zone, order, anchor)


def normalise_moments(rows: DataFrame, tenants: DataFrame, key: str, fields: dict[str, str | None]) -> DataFrame:
    """One row (row_id, field_name, raw, utc_us) for each non-null value of the named string fields.

    ``fields`` maps a field to the field whose instant dates its bare times, or
    None. ``rows`` needs ``key`` and ``tenant_id``; ``tenants`` gives
    ``time_zone`` and ``date_order``. A row whose tenant is null or unknown keeps
    the values that carry an offset. ``utc_us`` is null for values that name no
    instant. Repeated rows stay; other columns are ignored, whatever their names.
    The join is the only exchange, and only if ``tenants`` is large.
    """
    zones = tenants.where(F.col("tenant_id").isNotNull()).groupBy(F.col("tenant_id").alias("_tenant")).agg(F.min_by(F.struct("time_zone", "date_order"), "tenant_id").alias("_zone"))
    base = rows.select(F.col(key).alias("row_id"), F.col("tenant_id").alias("_tenant"), *[F.col(f).alias(f"_raw_{i}") for i, f in enumerate(fields)])
    base = base.join(broadcast_if_small(zones), "_tenant", "left")
    zone, order = F.col("_zone.time_zone"), F.col("_zone.date_order")
    names = list(fields)
    for i, f in enumerate(names):
        if fields[f] is None:
            base = base.withColumn(f"_utc_{i}", utc_micros(F.col(f"_raw_{i}"), zone, order))
    for i, f in enumerate(names):
        if fields[f] is not None:
            base = base.withColumn(f"_utc_{i}", utc_micros(F.col(f"_raw_{i}"), zone, order, F.col(f"_utc_{names.index(fields[f])}")))
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_raw_{i}").alias("raw"), F.col(f"_utc_{i}").alias("utc_us")) for i, f in enumerate(names)])
    return base.select("row_id", F.inline(each)).where(F.col("raw").isNotNull())
