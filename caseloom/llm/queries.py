"""Queries of the subpackage by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.garbled import fit_model, repaired
from caseloom.llm.language_runs import fit_profiles, segment_languages, text_runs
from caseloom.llm.mixing import mix, share_report
from caseloom.llm.name_links import row_classes, row_links
from caseloom.llm.packing import fill_report, pack
from caseloom.llm.pii import personal_details
from caseloom.llm.term_bitmaps import marked, normal_term, term_bitmaps, term_frequencies
from caseloom.llm.tokens import with_tokens
from caseloom.plans.sizing import cut
from caseloom.sources.tables import table


def p1_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run of one language in every message, with its confidence."""
    profiles = fit_profiles(table(spark, folder, "documents"))
    return text_runs(table(spark, folder, "inbound_message"), profiles, "message_id", "text").select("row_id", F.inline("runs"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts with a wrong or no label, segments of mixed transcripts, and runs of messages that are not all English."""
    profiles = fit_profiles(table(spark, folder, "documents"))
    spoken = segment_languages(table(spark, folder, "transcript"), profiles, "transcript_id", "segments", "language")
    pair = lambda no, lang: F.struct(no.cast("long").alias("run_no"), lang.alias("lang"))
    none = F.array().cast("array<struct<run_no:bigint,lang:string>>")
    wrong = F.when(~F.col("lang").eqNullSafe(F.col("named")), F.array(pair(F.lit(0), F.col("lang")))).otherwise(none)
    mixed = F.when(F.size(F.array_distinct(F.transform("segments", lambda s: s["lang"]))) > 1, F.transform("segments", lambda s: pair(s["segment_no"], s["lang"]))).otherwise(none)
    transcripts = spoken.select(F.lit("transcript").alias("table_name"), "row_id", F.inline(F.concat(wrong, mixed)))
    runs = text_runs(table(spark, folder, "inbound_message"), profiles, "message_id", "text").where(F.exists("runs", lambda r: r["lang"] != "en"))
    messages = runs.select(F.lit("inbound_message").alias("table_name"), "row_id", F.inline(F.transform("runs", lambda r: pair(r["run_no"], r["lang"]))))
    return transcripts.unionByName(messages)


def p2_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and cases of every term of both fields, with its mark."""
    rows = table(spark, folder, "emergent_attribute")
    bitmaps = term_bitmaps(rows, "case_id", {"head": normal_term(F.col("head")), "qualifier": normal_term(F.col("qualifier"))})
    total = rows.agg(F.count_distinct("case_id").alias("records_total"))
    return marked(term_frequencies(bitmaps), total, least=3, most_share=0.2)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The terms that are too rare or too common."""
    return p2_frequencies(spark, folder).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p4_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every value with personal details, with their places and with placeholders instead of them."""
    messages = personal_details(table(spark, folder, "inbound_message"), "message_id", {"text": F.col("text"), "sender": F.col("sender")})
    labels = personal_details(table(spark, folder, "cfpb_labels"), "id", {"gold_key_facts": F.col("gold_key_facts")})
    return messages.withColumn("table_name", F.lit("inbound_message")).unionByName(labels.withColumn("table_name", F.lit("cfpb_labels")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every mention of a personal detail."""
    return p4_masked(spark, folder).select("table_name", "row_id", "field_name", F.inline("spans")).select("table_name", "row_id", "field_name", "kind", "start_pos")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of one upload whose customer names mean the same."""
    links = row_links(row_classes(table(spark, folder, "spike_bakery_objects"), "object_id", "upload_id", "customer_name"))
    return links.select(F.col("id_a").cast("long").alias("object_id_a"), F.col("id_b").cast("long").alias("object_id_b")).distinct()


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of every row that names a customer: one row a record, copies included."""
    rows = row_classes(table(spark, folder, "spike_bakery_objects"), "object_id", "upload_id", "customer_name")
    return rows.select(F.col("id").cast("long").alias("object_id"), F.col("block").alias("upload_id"), "class_id", "score")


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or piece of one, for each kind of container."""
    sized = cut(with_tokens(table(spark, folder, "documents"), "doc_id", "text"))
    return pack(sized, table(spark, folder, "pack_capacity"), "doc_id", "tokens", "container_kind", "capacity_tokens")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each kind are."""
    return fill_report(p6_packed(spark, folder), table(spark, folder, "pack_capacity"), "container_kind", "capacity_tokens")


def p7_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in shards, each source with its target share of all tokens."""
    sized = with_tokens(table(spark, folder, "documents"), "doc_id", "text", "source")
    mixed = mix(sized, table(spark, folder, "mix_target"), "doc_id", "tokens", "source", "target_share", "max_repeats")
    return mixed.select(F.col("item_id").alias("doc_id"), "source", F.col("size").alias("tokens"), "repeat_no", "shard", "position")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixture reaches, by source."""
    mixed = p7_mixed(spark, folder).withColumnRenamed("tokens", "size")
    return share_report(mixed, table(spark, folder, "mix_target"), "source", "target_share", "max_repeats")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every garbled document with its state and what could be restored."""
    documents = table(spark, folder, "documents")
    return repaired(documents, fit_model(documents, stratum=F.col("lang"))).select(F.col("row_id").alias("doc_id"), "state", "restored")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents whose text shows a wrong decoding."""
    return p8_restored(spark, folder).select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_runs": p1_runs, "p2_found": p2_found, "p2_frequencies": p2_frequencies, "p4_found": p4_found, "p4_masked": p4_masked, "p5_found": p5_found, "p5_classes": p5_classes,
    "p6_packed": p6_packed, "p6_fill": p6_fill, "p7_mixed": p7_mixed, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored,
}

_P2_TERMS = """
    WITH long AS (
        SELECT 'head' AS field_name, head AS raw, case_id FROM emergent_attribute
        UNION ALL SELECT 'qualifier', qualifier, case_id FROM emergent_attribute),
    terms AS (
        SELECT field_name, trim(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '_') AS term, case_id FROM long WHERE raw IS NOT NULL),
    counted AS (
        SELECT field_name, term, count(*) AS occurrences, count(DISTINCT case_id) AS records FROM terms WHERE term <> '' GROUP BY 1, 2),
    total AS (SELECT count(DISTINCT case_id) AS n FROM emergent_attribute),
    named AS (
        SELECT field_name, term, occurrences, records,
               CASE WHEN records < 3 THEN 'rare' WHEN records > 0.2 * n THEN 'common' END AS mark
        FROM counted CROSS JOIN total)
"""
SQL: dict[str, str] = {
    "p2_frequencies": _P2_TERMS + "SELECT field_name, term, occurrences, records, mark FROM named",
    "p2_found": _P2_TERMS + "SELECT field_name, term, mark FROM named WHERE mark IS NOT NULL",
}
