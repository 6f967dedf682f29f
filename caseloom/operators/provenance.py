"""Where values come from: their places in source texts, and spans to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.ordered import first_by, prefix_sum

#: Values of a case that one row carries to its documents.
CHUNK = 500


def located_values(values: DataFrame, documents: DataFrame, case: str, value: str, document: str, text: str) -> DataFrame:
    """(case, value, document, char_start, char_end) of each distinct value of a case that its documents have, case aside: the first such document by id and the first place in it.

    Offsets count in the case's documents joined by a line break in order of id;
    the bases are prefix sums, no text is joined. A case's values go to its
    documents in chunks of bounded size, and every chunk is looked for in a
    document in one pass of the engine. Null cases, texts and blank values have
    no place.
    """
    d = documents.where(F.col(case).isNotNull() & F.col(text).isNotNull()).select(F.col(case).alias("_case"), F.col(document).alias("_doc"), F.col(text).alias("_text"))
    d = prefix_sum(d.withColumn("_len", F.length("_text") + 1), ["_case"], "_doc", [], F.col("_len"), "_upto")
    v = values.where(F.col(case).isNotNull() & (F.trim(value) != "")).select(F.col(case).alias("_case"), F.trim(value).alias("_value")).distinct()
    number = v.groupBy("_case").agg(F.ceil(F.count("*") / CHUNK).alias("_of"))
    v = v.join(number, "_case").groupBy("_case", F.pmod(F.xxhash64("_value"), F.col("_of")).alias("_chunk")).agg(F.collect_list("_value").alias("_values"))
    low = F.lower("_text")
    hits = F.filter(F.transform("_values", lambda x: F.struct(x.alias("_value"), F.instr(low, F.lower(x)).alias("_at"))), lambda s: s["_at"] > 0)
    found = d.join(v, "_case").select("_case", "_doc", (F.col("_upto") - F.col("_len")).alias("_base"), F.inline(hits))
    found = found.select("_case", "_value", "_doc", (F.col("_base") + F.col("_at") - 1).alias("char_start"))
    first = first_by(found, ["_case", "_value"], ["_doc"], ["_doc", "char_start"])
    return first.select(F.col("_case").alias(case), F.col("_value").alias(value), F.col("_doc").alias(document), "char_start", (F.col("char_start") + F.length("_value")).alias("char_end"))


def disjoint_spans(spans: Column, length: Column) -> Column:
    """Spans (start, end) to highlight in a text: sorted, clamped to it, empty ones dropped, and those that begin inside an earlier one skipped; null counts as none."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    clamped = F.transform(spans, lambda s: F.struct(F.greatest(s["start"], F.lit(0)).cast("int").alias("start"), F.least(s["end"], length).cast("int").alias("end")))
    ordered = F.array_sort(F.filter(clamped, lambda s: s["start"] < s["end"]))
    kept = F.aggregate(ordered, none, lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= F.element_at(acc, -1)["end"]), F.concat(acc, F.array(s))).otherwise(acc))
    return F.coalesce(kept, none)


def grounded_claims(claims: Column, record: Column) -> Column:
    """Claims (record_field, record_value, claim) that cite a field the record has, with value and claim not empty; others are dropped."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    return F.filter(claims, lambda c: F.map_contains_key(record, c["record_field"]) & filled(c["record_value"]) & filled(c["claim"]))
