"""Resolving a reference to one record by identifiers of unknown columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions import text as t
from caseloom.operators.vectors import nearest
from caseloom.plans.sizing import broadcast_if_small


def melt(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of the non-blank values of columns, as strings."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(f).cast("string")).alias("value")) for f in fields])
    return df.select(key, F.inline(each)).where(F.col("value") != "")


def profile_fields(cells: DataFrame, unique_from: float = 0.9, contact_from: float = 0.8) -> DataFrame:
    """(field, filled, distinct_values, uniqueness, contact_share, is_key): a field is a key if nearly unique or a contact by name or by its values.

    Values are counted by (field, value) first, so a frequent value is one row a
    task before the exchange.
    """
    counts = cells.groupBy("field", "value").agg(F.count("*").alias("n"))
    shape = F.sum(F.when(t.contact_value(F.col("value")), F.col("n")).otherwise(0))
    out = counts.groupBy("field").agg(F.sum("n").alias("filled"), F.count("*").alias("distinct_values"), shape.alias("_c"))
    out = out.withColumn("uniqueness", F.col("distinct_values") / F.col("filled")).withColumn("contact_share", F.col("_c") / F.col("filled"))
    is_key = (F.col("uniqueness") >= unique_from) | t.contact_name(F.col("field")) | (F.col("contact_share") >= contact_from)
    return out.select("field", "filled", "distinct_values", "uniqueness", "contact_share", is_key.alias("is_key"))


def external_ids(cells: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """(key, field, value): each record's display id, by preference a key named like an identifier, then any that is no contact, then any; within these the most unique, then by name."""
    keys = broadcast_if_small(profile.where("is_key").select("field", "uniqueness"))
    tier = F.when(t.identifier_name(F.col("field")) & ~t.contact_name(F.col("field")), 0).when(~t.contact_name(F.col("field")), 1).otherwise(2)
    best = F.min_by(F.struct("field", "value"), F.struct(tier, -F.col("uniqueness"), F.col("field")))
    return cells.join(keys, "field").groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def resolve_outcome(anchor: Column, id_hits: Column, phone: Column, phone_hits: Column, agrees: Column) -> Column:
    """silent, confirm or elicit by exact keys: a quoted id found once binds unless the phone points elsewhere; an unknown or ambiguous id asks; then the phone; without either it elicits."""
    by_id = F.when((id_hits == 1) & (phone_hits > 0) & ~agrees, "confirm").when(id_hits == 1, "silent").otherwise("confirm")
    return F.when(anchor.isNotNull(), by_id).when(phone.isNotNull() & (phone_hits == 1), "silent").when(phone.isNotNull() & (phone_hits > 1), "confirm").otherwise("elicit")


def resolve_with_name(anchor: Column, id_hits: Column, phone: Column, phone_hits: Column, agrees: Column, similarity: Column, margin: Column, tau: float = 0.72, least_margin: float = 0.06) -> Column:
    """``resolve_outcome`` with the name as third step: where neither id nor phone decides, the nearest record by name binds silently if its ``similarity`` reaches ``tau`` and its ``margin`` over the runner-up ``least_margin``, asks if only the first holds, and else elicits. Without a name both are null."""
    by_name = F.when((similarity >= tau) & (margin >= least_margin), "silent").when(similarity >= tau, "confirm").otherwise("elicit")
    exact = resolve_outcome(anchor, id_hits, phone, phone_hits, agrees)
    return F.when(exact == "elicit", by_name).otherwise(exact)


def match_quality(df: DataFrame, keys: list[str], mode: str, bound: str, true_mode: str, true_object: str) -> DataFrame:
    """Per key: cases, silent and wrong binds, those that ought to bind and how many did, and cases that behaved.

    A silent bind is wrong unless it bound the true record; none stated makes it
    wrong. A case behaved if its mode is the true one, where confirm and elicit
    count as the same: not bound.
    """
    silent, wanted = F.col(mode) == "silent", F.col(true_mode) == "silent"
    right = F.coalesce(F.col(bound) == F.col(true_object), F.lit(False))
    recalled = wanted & silent & F.col(true_object).isNotNull()
    return df.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if(silent).alias("silent"), F.count_if(silent & ~right).alias("wrong_binds"),
        F.count_if(wanted).alias("resolvable"), F.count_if(recalled).alias("recalled"), F.count_if(silent == wanted).alias("behaved"),
    )


def top_margin(pairs: DataFrame) -> DataFrame:
    """(id_a, best, similarity, margin) of ranked neighbours; an absent runner-up counts as 0."""
    w = Window.partitionBy("id_a").orderBy("rank")
    return pairs.withColumn("margin", F.col("similarity") - F.coalesce(F.lead("similarity").over(w), F.lit(0.0))).where("rank = 1").select("id_a", F.col("id_b").alias("best"), "similarity", "margin")


def name_vector(name: Column, width: int = 128) -> Column:
    """A name as a vector: counts of its padded character trigrams, hashed to ``width`` places. Names of like spelling have a high cosine; null and blank names have none."""
    padded = F.concat(F.lit("  "), F.lower(F.trim(name)), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.pmod(F.xxhash64(F.substring(padded, i, F.lit(3))), F.lit(width)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.size(F.filter(grams, lambda g: g == k)).cast("double"))
    return F.when(F.trim(name) != "", counts)


def resolve_by_name(probes: DataFrame, records: DataFrame, key: str, within: str, name: str, tau: float = 0.72, least_margin: float = 0.06) -> DataFrame:
    """(key, mode, bound) of probes that have only a name: the nearest record of their group binds silently from ``tau`` and ``least_margin`` on, is asked about from ``tau`` on, and else nothing is known.

    ``key`` of both is a long. Probes are a stated query set; they meet all
    records of their group in blocks. Blank names elicit.
    """
    vector = lambda df, sign: df.select((F.col(key) * sign).alias("id"), F.col(within).alias("g"), name_vector(F.col(name)).alias("v"))
    near = top_margin(nearest(vector(probes, -1), vector(records, 1), "id", "v", 2, within="g"))
    out = probes.select(key).join(near.select((-F.col("id_a")).alias(key), "best", "similarity", "margin"), key, "left")
    none = F.lit(None).cast("string")
    mode = resolve_with_name(none, F.lit(0), none, F.lit(0), F.lit(False), F.coalesce("similarity", F.lit(0.0)), F.coalesce("margin", F.lit(0.0)), tau, least_margin)
    return out.select(key, mode.alias("mode"), F.when(mode == "silent", F.col("best")).alias("bound"))
