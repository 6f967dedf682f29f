"""Append-only logs, their projections and idempotent writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.ordered import first_by, latest_by


def scope(df: DataFrame, tenant: object | None, column: str = "tenant_id") -> DataFrame:
    """The rows of one tenant; without a tenant there are none."""
    return df.where(F.lit(False)) if tenant is None else df.where(F.col(column) == F.lit(tenant))


def scope_all(df: DataFrame) -> DataFrame:
    """All tenants' rows, for maintenance; said in so many words."""
    return df


def capability(df: DataFrame, column: str, key: str | None) -> DataFrame:
    """The rows that a capability key opens; a blank key opens none."""
    key = (key or "").strip()
    return df.where(F.col(column) == key) if key else df.where(F.lit(False))


def project_current(extractions: DataFrame, corrections: DataFrame, keys: Sequence[str], seq: str, value: str) -> DataFrame:
    """Current value of each key: the latest correction, else the latest extraction (keys, value, origin, seq).

    A correction counts by its presence: one to null wins over any extraction.
    Both logs are folded by aggregates before they meet.
    """
    e = latest_by(extractions, keys, [seq], [value, seq])
    c = latest_by(corrections, keys, [seq], [value, seq])
    left = e.select(*keys, F.struct(value, seq).alias("_e"))
    right = c.select(*keys, F.struct(value, seq).alias("_c"))
    both = left.join(right, list(keys), "full_outer")
    chosen = F.coalesce("_c", "_e")
    return both.select(*keys, chosen[value].alias(value), F.when(F.col("_c").isNotNull(), "correction").otherwise("extraction").alias("origin"), chosen[seq].alias(seq))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The incoming rows to append: the first of each key that is not there yet. Null keys are never equal to a stored one but to each other."""
    values = [c for c in incoming.columns if c not in keys]
    return first_by(incoming, keys, order, values).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Old rows replaced by new ones of the same key with a version at least as high."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_by(both, keys, [version, "_new"], [c for c in old.columns if c not in keys])


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Upsert in which a null in one of ``kept`` leaves the old value."""
    a = old.select(*keys, F.struct(*kept).alias("_o"))
    b = new.select(*keys, F.struct(*kept).alias("_n"))
    both = a.join(b, list(keys), "full_outer")
    return both.select(*keys, *[F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")).alias(c) for c in kept])


def set_columns(df: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keyed column updates: a non-null value of ``changes`` replaces the old one."""
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(new, list(keys), "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def first_writer(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The stamp of each key's first writer; later ones change nothing."""
    return first_by(df, keys, order, values)


def guarded(state: Column, allowed: Sequence[str], target: Column) -> Column:
    """``target`` where the state may change, else the state as it is; a null state stays."""
    return F.when(state.isin(*allowed), target).otherwise(state)


def unclaimed(work: DataFrame, ledger: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """Work whose key is not done in the ledger; failed claims may be taken again. Each key once."""
    return work.select(*keys).distinct().join(ledger.where(F.col(status) == "done").select(*keys).distinct(), list(keys), "left_anti")


def idempotency_key(*parts: Column) -> Column:
    """SHA-256 over the parts joined by the unit separator; nulls count as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row (key, rule) for each broken rule of each row; a rule that is null is not broken."""
    broken = F.array_compact(F.array(*[F.when(~ok, name) for name, ok in rules.items()]))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def json_set(doc: Column, key: str, value: Column) -> Column:
    """A flat JSON object of strings with one member set; a null or invalid document counts as empty."""
    old = F.coalesce(F.from_json(doc, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    keep = F.map_filter(old, lambda k, _: k != key)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(keep, F.create_map(F.lit(key), value.cast("string")))))))


def canonical_json(attributes: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attributes))))
