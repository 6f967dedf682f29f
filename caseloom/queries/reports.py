"""Queries that list, review and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as t
from caseloom.operators.ordered import latest_by, numbered
from caseloom.operators.provenance import disjoint_spans, grounded_claims
from caseloom.sources.objects import synthetic_orders, webhook_messages
from caseloom.sources.tables import table


_REPORTED = (("category", "gold_category"), ("outcome", "gold_desired_outcome"), ("severity", "gold_severity_signal"), ("emotion", "gold_emotion_signal"))
_ALLOWED = ("image/jpeg", "image/png", "image/webp", "application/pdf", "audio/ogg", "audio/mpeg", "audio/mp4", "text/plain")


def register(spark: SparkSession, folder: str) -> DataFrame:
    """Register of customers: orders, least price, latest status; the newest 200 of them, which is the report's limit."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    a = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("fields"), F.min("o_totalprice").alias("least"), F.max("o_orderdate").alias("last"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    j = c.join(a, "c_custkey").select("c_custkey", "c_mktsegment", "fields", "least", "status", F.col("last").cast("timestamp_ntz").alias("last_order"))
    return j.orderBy(F.desc("last_order"), "c_custkey").limit(200)


def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    """The first 100 orders to review: failed ones, then the rest by price, unknown last."""
    o = table(spark, folder, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.select("o_orderkey", rank.alias("rank"), "o_totalprice").orderBy("rank", F.coalesce("o_totalprice", F.lit(float("inf"))), "o_orderkey").limit(100)


def case_review(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of each case: documents, latest document, attributes, least grounded, by two joins instead of lookups."""
    d = table(spark, folder, "documents").where("case_id IS NOT NULL")
    docs = d.groupBy("case_id").agg(F.count("*").alias("documents"), F.max("received_at").cast("timestamp_ntz").alias("last_document"), F.max_by("source", F.struct("received_at", "doc_id")).alias("last_source"))
    a = table(spark, folder, "emergent_attribute").groupBy("case_id").agg(F.count("*").alias("attributes"), F.count_if(~F.col("grounded")).alias("ungrounded"))
    zero = F.lit(0).cast("long")
    return docs.join(a, "case_id", "full_outer").select("case_id", F.coalesce("documents", zero).alias("documents"), "last_document", "last_source", F.coalesce("attributes", zero).alias("attributes"), F.coalesce("ungrounded", zero).alias("ungrounded"))


def case_report(spark: SparkSession, folder: str) -> DataFrame:
    """Report fields of the complaints that have a category: in fixed order, said where not stated."""
    c = table(spark, folder, "cfpb_labels").where("gold_category IS NOT NULL")
    stated = lambda f: F.coalesce(F.nullif(F.trim(F.col(f)), F.lit("")), F.lit("not stated"))
    return c.select("id", F.concat_ws(" | ", *[F.concat(F.lit(f"{n}: "), stated(f)) for n, f in (("category", "gold_category"), ("outcome", "gold_desired_outcome"), ("severity", "gold_severity_signal"), ("emotion", "gold_emotion_signal"))]).alias("report"))


def case_report_html(spark: SparkSession, folder: str) -> DataFrame:
    """The report of each complaint with a category as a page: a definition list in fixed order, values escaped, "not stated" where blank."""
    c = table(spark, folder, "cfpb_labels").where("gold_category IS NOT NULL")
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = [F.concat(F.lit(f"<dt>{n}</dt><dd>"), escaped(F.coalesce(F.nullif(F.trim(F.col(f)), F.lit("")), F.lit("not stated"))), F.lit("</dd>")) for n, f in _REPORTED]
    return c.select("id", F.concat(F.lit("<!doctype html><dl>"), *rows, F.lit("</dl>")).alias("html"))


def attachment_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Messages whose attachments an edge takes: every media type is listed, none is over 10 MB, all together are not over 25 MB; counted by channel with the reason of the first refusal."""
    a = table(spark, folder, "inbound_message").select("message_id", "channel", F.explode("attachments").alias("a"))
    size = F.coalesce(F.length("a.data"), F.lit(0)).cast("long")
    per = a.groupBy("message_id", "channel").agg(F.bool_and(F.coalesce(F.col("a.mime").isin(*_ALLOWED), F.lit(False))).alias("listed"), F.max(size).alias("largest"), F.sum(size).alias("total"))
    verdict = F.when(~F.col("listed"), "media type").when(F.col("largest") > 10_000_000, "file too large").when(F.col("total") > 25_000_000, "message too large").otherwise("taken")
    return per.groupBy("channel", verdict.alias("verdict")).agg(F.count("*").alias("messages"))


def case_references(spark: SparkSession, folder: str) -> DataFrame:
    """Short reference of every case and the model tag of its latest document's source."""
    d = table(spark, folder, "documents").where("case_id IS NOT NULL")
    last = latest_by(d, ["case_id"], ["received_at", "doc_id"], ["source"])
    tag = F.when(F.col("source") == "voice_transcript", "asr").when(F.col("source") == "scanned_letter", "ocr").otherwise("text")
    return last.select("case_id", F.concat(F.lit("C-"), F.upper(F.element_at(F.split("case_id", "-"), -1).substr(-8, 8))).alias("reference"), tag.alias("model"))


def webhook_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Messages wrapped as webhook payloads and flattened again: text ones by channel of the sender's first sign."""
    m = table(spark, folder, "inbound_message")
    msg = F.struct(F.col("sender").alias("from"), F.when(F.col("text").isNotNull(), "text").otherwise("image").alias("type"), F.struct(F.col("text").alias("body")).alias("text"))
    payload = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.struct(F.array(msg).alias("messages")).alias("value"))).alias("changes"))).alias("entry")))
    return webhook_messages(m.select(payload.alias("p")), "p").groupBy(F.substring("sender", 1, 1).alias("first")).agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))


def highlighted_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans to highlight in each message: every "order" and ten characters from every "the", clamped to the text, none over another."""
    m = table(spark, folder, "inbound_message").where("text IS NOT NULL")
    starts = lambda word: F.transform(F.filter(F.sequence(F.lit(0), F.length("text")), lambda i: F.lower(F.substring("text", i + 1, len(word))) == word), lambda i: i)
    wanted = F.concat(F.transform(starts("order"), lambda i: F.struct(i.alias("start"), (i + 5).alias("end"))), F.transform(starts("the"), lambda i: F.struct(i.alias("start"), (i + 10).alias("end"))))
    spans = m.select("message_id", disjoint_spans(wanted, F.length("text")).alias("s")).where(F.size("s") > 0)
    return spans.select("message_id", F.size("s").cast("long").alias("spans"), F.aggregate("s", F.lit(0), lambda n, x: n + x["end"] - x["start"]).cast("long").alias("covered"), F.element_at("s", -1)["end"].cast("long").alias("last_end"))


def grounded_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """Contradictions that cite a field of the uploaded record, by field: claims on absent fields and empty claims are dropped."""
    o = table(spark, folder, "spike_bakery_objects")
    record = F.map_filter(F.create_map(*[c for f in ("order_id", "phone", "customer_name", "slot", "delivered_at") for c in (F.lit(f), F.col(f))]), lambda _, v: v.isNotNull())
    claim = lambda f, v, c: F.struct(F.lit(f).alias("record_field"), v.alias("record_value"), c.alias("claim"))
    claims = F.array(claim("slot", F.col("slot"), F.col("delivered_at")), claim("phone", F.col("phone"), F.col("items")), claim("driver", F.col("items"), F.col("items")))
    return o.select(F.explode(grounded_claims(claims, record)).alias("c")).groupBy(F.col("c.record_field").alias("record_field")).agg(F.count("*").alias("n"))


def pending_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The question that waits in the state document of each order in progress, read by its path."""
    o = table(spark, folder, "orders")
    doc = F.to_json(F.struct(F.struct(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("priority "), "o_orderpriority")).alias("next_question")).alias("elicit")))
    return o.where("o_orderstatus = 'P'").select("o_orderkey", F.get_json_object(doc, "$.elicit.next_question").alias("question")).where("question IS NOT NULL")


def case_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and files of each case, not its other documents, in the order they came."""
    d = table(spark, folder, "documents").where(F.col("case_id").isNotNull() & F.col("source").isin("chat_export", "email", "scanned_letter"))
    return numbered(d.select("case_id", "doc_id", "received_at"), ["case_id"], "received_at", ["doc_id"], "position").select("case_id", "doc_id", "position")


def undeduped_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Names that still have to be compared: those that are no head alone and have no vector yet."""
    a = table(spark, folder, "emergent_attribute")
    names = a.select(t.snake(F.col("head")).alias("head"), t.compose_name(t.snake(F.col("head")), t.snake(F.col("qualifier"))).alias("name")).where("name <> head").distinct()
    done = a.where("grounded").select(t.compose_name(t.snake(F.col("head")), t.snake(F.col("qualifier"))).alias("name")).distinct()
    return names.join(done, "name", "left_anti").select("head", "name")


def object_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One record by its identifier, a point lookup that the scan's filter serves."""
    return table(spark, folder, "spike_bakery_objects").where("object_id = 42").select("object_id", "tenant_id", "order_id", "items")


def json_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Properties that are objects, and those that are anything else: these count as empty."""
    e = table(spark, folder, "events")
    doc = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.col("props"))).otherwise(F.col("props"))
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json(doc)).startswith("OBJECT"), F.lit(False))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("objects"))


def layer_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Layer of every attribute by its composed name where none is given: an underscore means emergent."""
    a = table(spark, folder, "emergent_attribute").withColumn("name", t.compose_name(F.col("head"), F.col("qualifier")))
    return a.groupBy(F.when(F.contains("name", F.lit("_")), "emergent").otherwise("governed").alias("layer")).agg(F.count("*").alias("n"))


def low_values(spark: SparkSession, folder: str) -> DataFrame:
    """Attributes whose value is a small whole number; values that are none are dropped."""
    a = table(spark, folder, "emergent_attribute").withColumn("v", F.expr("try_cast(value AS int)"))
    return a.where("v <= 500").groupBy("head").agg(F.count("*").alias("n"))


def upload_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads within limits: rows with allowed items, and the sum of their sizes by upload."""
    o = table(spark, folder, "spike_bakery_objects").withColumn("size", F.length("items"))
    x = o.groupBy("upload_id").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    return x.withColumn("accepted", (F.col("bytes") <= 25_000_000) & (F.col("largest") <= 10_000_000))


def synthetic_truth(spark: SparkSession, folder: str) -> DataFrame:
    """The seeded generator: orders and distinct phones of a run as large as the order table."""
    n = table(spark, folder, "orders").count()
    s = synthetic_orders(spark, n)
    return s.agg(F.count("*").alias("orders"), F.count_distinct("phone").alias("phones"), F.count_if("shared").alias("shared"))


QUERIES = {f.__name__: f for f in (
    register, review_queue, case_review, case_report, case_report_html, attachment_limits, case_references, webhook_flatten, highlighted_spans, grounded_contradictions, pending_questions, case_documents, undeduped_variants, object_lookup, json_guard, layer_fallback, low_values, upload_limits, synthetic_truth,
)}

_NAME = "trim(regexp_replace(lower(head), '[^a-z0-9]+', '_', 'g'), '_')"
SQL = {
    "register": """
        SELECT c_custkey, c_mktsegment, count(*) AS fields, min(o_totalprice) AS least, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_orderdate) AS last_order
        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY last_order DESC, c_custkey LIMIT 200""",
    "review_queue": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS rank, o_totalprice FROM orders ORDER BY rank, o_totalprice NULLS LAST, o_orderkey LIMIT 100",
    "case_review": """
        WITH d AS (SELECT case_id, count(*) AS documents, max(received_at) AS last_document, max_by(source, (received_at, doc_id)) AS last_source FROM documents WHERE case_id IS NOT NULL GROUP BY 1),
        a AS (SELECT case_id, count(*) AS attributes, count(*) FILTER (NOT grounded) AS ungrounded FROM emergent_attribute GROUP BY 1)
        SELECT coalesce(d.case_id, a.case_id) AS case_id, coalesce(documents, 0) AS documents, last_document, last_source, coalesce(attributes, 0) AS attributes, coalesce(ungrounded, 0) AS ungrounded FROM d FULL JOIN a ON d.case_id = a.case_id""",
    "case_report": """
        SELECT id, 'category: ' || coalesce(nullif(trim(gold_category), ''), 'not stated') || ' | outcome: ' || coalesce(nullif(trim(gold_desired_outcome), ''), 'not stated')
        || ' | severity: ' || coalesce(nullif(trim(gold_severity_signal), ''), 'not stated') || ' | emotion: ' || coalesce(nullif(trim(gold_emotion_signal), ''), 'not stated') AS report FROM cfpb_labels WHERE gold_category IS NOT NULL""",
    "case_report_html": "SELECT id, '<!doctype html><dl>' || " + " || ".join(f"'<dt>{n}</dt><dd>' || replace(replace(replace(coalesce(nullif(trim({f}), ''), 'not stated'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</dd>'" for n, f in _REPORTED) + " || '</dl>' AS html FROM cfpb_labels WHERE gold_category IS NOT NULL",
    "attachment_limits": f"""
        WITH a AS (SELECT message_id, channel, unnest(attachments) AS a FROM inbound_message),
        p AS (SELECT message_id, channel, bool_and(coalesce(a.mime IN {_ALLOWED}, false)) AS listed, max(coalesce(octet_length(a.data), 0)) AS largest, sum(coalesce(octet_length(a.data), 0)) AS total FROM a GROUP BY 1, 2)
        SELECT channel, CASE WHEN NOT listed THEN 'media type' WHEN largest > 10000000 THEN 'file too large' WHEN total > 25000000 THEN 'message too large' ELSE 'taken' END AS verdict, count(*) AS messages FROM p GROUP BY 1, 2""",
    "case_references": """
        SELECT case_id, 'C-' || upper(right(string_split(case_id, '-')[-1], 8)) AS reference, CASE max_by(source, (received_at, doc_id)) WHEN 'voice_transcript' THEN 'asr' WHEN 'scanned_letter' THEN 'ocr' ELSE 'text' END AS model
        FROM documents WHERE case_id IS NOT NULL GROUP BY 1""",
    "webhook_flatten": "SELECT substr(sender, 1, 1) AS first, count(*) AS messages, sum(length(text))::BIGINT AS chars FROM inbound_message WHERE text IS NOT NULL GROUP BY 1",
    "highlighted_spans": """
        WITH RECURSIVE w AS (SELECT message_id, length(text) AS len, i AS s, least(CASE WHEN lower(text[i + 1:i + 5]) = 'order' THEN i + 5 ELSE i + 10 END, length(text)) AS e
            FROM (SELECT message_id, text, unnest(range(0, length(text))) AS i FROM inbound_message WHERE text IS NOT NULL) WHERE lower(text[i + 1:i + 5]) = 'order' OR lower(text[i + 1:i + 3]) = 'the'),
        k AS (SELECT message_id, min(s) AS s, min_by(e, (s, e)) AS e FROM w GROUP BY 1
            UNION ALL SELECT k.message_id, n.s, n.e FROM k, LATERAL (SELECT w.s, w.e FROM w WHERE w.message_id = k.message_id AND w.s >= k.e ORDER BY w.s, w.e LIMIT 1) n)
        SELECT message_id, count(*) AS spans, sum(e - s)::BIGINT AS covered, max(e) AS last_end FROM k GROUP BY 1""",
    "grounded_contradictions": """
        SELECT record_field, count(*) AS n FROM (SELECT 'slot' AS record_field FROM spike_bakery_objects WHERE slot <> '' AND delivered_at <> '' UNION ALL SELECT 'phone' FROM spike_bakery_objects WHERE phone <> '' AND items <> '') GROUP BY 1""",
    "pending_questions": "SELECT o_orderkey, 'priority ' || o_orderpriority AS question FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 3 = 0",
    "case_documents": "SELECT case_id, doc_id, row_number() OVER (PARTITION BY case_id ORDER BY received_at, doc_id) AS position FROM documents WHERE case_id IS NOT NULL AND source IN ('chat_export', 'email', 'scanned_letter')",
    "undeduped_variants": f"""
        WITH a AS (SELECT {_NAME} AS h, {_NAME.replace('head', 'qualifier')} AS q, grounded FROM emergent_attribute), n AS (SELECT h AS head, CASE WHEN coalesce(q, '') NOT IN ('', h) THEN q || '_' || h ELSE h END AS name, grounded FROM a)
        SELECT DISTINCT head, name FROM n WHERE name <> head AND name NOT IN (SELECT name FROM n WHERE grounded)""",
    "object_lookup": "SELECT object_id, tenant_id, order_id, items FROM spike_bakery_objects WHERE object_id = 42",
    "json_guard": "SELECT event_type, count(*) AS n, count(*) FILTER (event_type <> 'error') AS objects FROM events GROUP BY 1",
    "layer_fallback": f"""
        WITH a AS (SELECT {_NAME} AS h, {_NAME.replace('head', 'qualifier')} AS q FROM emergent_attribute)
        SELECT CASE WHEN contains(CASE WHEN coalesce(q, '') NOT IN ('', h) THEN q || '_' || h ELSE h END, '_') THEN 'emergent' ELSE 'governed' END AS layer, count(*) AS n FROM a GROUP BY 1""",
    "low_values": "SELECT head, count(*) AS n FROM emergent_attribute WHERE regexp_matches(value, '^[+-]?[0-9]+$') AND value::INT <= 500 GROUP BY 1",
    "upload_limits": "SELECT upload_id, count(*) AS rows, sum(length(items))::BIGINT AS bytes, max(length(items)) AS largest, sum(length(items)) <= 25000000 AND max(length(items)) <= 10000000 AS accepted FROM spike_bakery_objects GROUP BY 1",
}
