"""Queries over logs: current values, idempotent writes, constraints, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import logs
from caseloom.operators.ordered import latest_by
from caseloom.sources.tables import table

_K = "props::JSON->>'$.k'"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))


def current_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Latest correction, else latest extraction, of each (user, k); error events are the corrections."""
    e = _events(spark, folder)
    values = ["user_id", "k", "event_id", "value"]
    out = logs.project_current(e.where("event_type <> 'error'").select(*values), e.where("event_type = 'error'").select(*values), ["user_id", "k"], "event_id", "value")
    return out.select("user_id", "k", "value", "origin", "event_id")


def latest_order_per_customer(spark: SparkSession, folder: str) -> DataFrame:
    """The last order of each customer."""
    o = table(spark, folder, "orders")
    return latest_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_orderstatus"])


def last_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Last activity of every customer: the first contact, or a later order."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("m"), F.count("*").alias("orders"))
    first = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    return c.join(last, "c_custkey", "left").select("c_custkey", F.greatest(first, F.coalesce(F.col("m").cast("timestamp_ntz"), first)).alias("last_activity"), F.coalesce("orders", F.lit(0)).alias("orders"))


def first_writer_stamp(spark: SparkSession, folder: str) -> DataFrame:
    """The first purchase of each user stays its stamp."""
    e = table(spark, folder, "events").where("event_type = 'purchase'")
    return logs.first_writer(e, ["user_id"], ["ts", "event_id"], ["event_id", "ts"])


def insert_if_absent(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to store by content hash: those that no e-mail has stored yet, each content once."""
    d = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return logs.insert_if_absent(d.where("source = 'email'"), d.where("source <> 'email'"), ["sha"], ["doc_id"]).select("sha", "doc_id", "source")


def idempotent_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and their replay count once by (tenant, sender, time, content)."""
    m = table(spark, folder, "inbound_message").select("tenant_id", "sender", "sent_at", "text")
    return m.unionByName(m).distinct().groupBy("tenant_id").agg(F.count("*").alias("messages"))


def idempotency_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Key of every event over its type, user and properties."""
    e = table(spark, folder, "events")
    return e.select("event_id", logs.idempotency_key(F.col("event_type"), F.col("user_id"), F.col("props")).alias("idempotency_key"))


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Order rows of an upload replaced by the later upload of the same order."""
    o = table(spark, folder, "spike_bakery_objects").select("tenant_id", "order_id", "object_id", "upload_id", "items")
    firsts = o.groupBy("tenant_id").agg(F.min("upload_id").alias("first_upload"))
    o = o.join(firsts, "tenant_id")
    old, new = o.where("upload_id = first_upload").drop("first_upload"), o.where("upload_id > first_upload").drop("first_upload")
    return logs.upsert(old, new, ["tenant_id", "order_id"], "object_id")


def upsert_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    """Phone and name of each order: the last row's, but for what it leaves out."""
    o = table(spark, folder, "spike_bakery_objects")
    keys = ["tenant_id", "order_id"]
    old = logs.first_writer(o, keys, ["object_id"], ["phone", "customer_name"])
    new = latest_by(o, keys, ["object_id"], ["phone", "customer_name"])
    return logs.upsert_coalesce(old, new, keys, ["phone", "customer_name"])


def keyed_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Account balances replaced by the greatest order of the customer, where there is one."""
    c = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    changes = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return logs.set_columns(c, changes, ["c_custkey"], ["c_acctbal"])


def guarded_transition(spark: SparkSession, folder: str) -> DataFrame:
    """Open orders older than a stated day fail; others keep their status."""
    o = table(spark, folder, "orders")
    late = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    return o.select("o_orderkey", F.when(late, logs.guarded(F.col("o_orderstatus"), ["O"], F.lit("X"))).otherwise(F.col("o_orderstatus")).alias("status")).groupBy("status").agg(F.count("*").alias("orders"))


def claim_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Work (user, k) that is not done: purchases are done claims, errors failed ones."""
    e = _events(spark, folder)
    ledger = e.select("user_id", "k", F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").alias("status"))
    return logs.unclaimed(e, ledger, ["user_id", "k"])


def outbound_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Outbound texts by (case, hash of the text): each claimed once, by its first document."""
    d = table(spark, folder, "documents").where("case_id IS NOT NULL")
    keyed = d.select("case_id", logs.idempotency_key(F.col("case_id"), F.col("text")).alias("claim"), "doc_id")
    return logs.first_writer(keyed, ["case_id", "claim"], ["doc_id"], ["doc_id"])


def check_constraints(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that break a stated constraint, counted by rule."""
    x = table(spark, folder, "lineitem").withColumn("row_key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    rules = {"quantity_range": F.col("l_quantity").between(1, 45), "discount_range": F.col("l_discount") <= 0.08, "flag_enum": F.col("l_returnflag").isin("A", "N"), "tax_not_negative": F.col("l_tax") >= 0}
    return logs.violations(x, "row_key", rules).groupBy("rule").agg(F.count("*").alias("broken"))


def corrections_locked(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections of (user, k) that are not committed; a purchase commits."""
    e = _events(spark, folder)
    committed = e.where("event_type = 'purchase'").select("user_id", "k").distinct()
    return e.where("event_type = 'error'").join(committed, ["user_id", "k"], "left_anti").groupBy("user_id").agg(F.count("*").alias("corrections"))


def json_member_set(spark: SparkSession, folder: str) -> DataFrame:
    """Properties with the event's type set as a member, then read again."""
    e = table(spark, folder, "events").withColumn("doc", logs.json_set(F.col("props"), "state", F.col("event_type")))
    return e.groupBy(F.get_json_object("doc", "$.state").alias("state"), F.get_json_object("doc", "$.k").alias("k")).agg(F.count("*").alias("n"))


def citations(spark: SparkSession, folder: str) -> DataFrame:
    """One citation for each segment of a transcript, with its place in time."""
    t = table(spark, folder, "transcript")
    return t.select("transcript_id", F.posexplode("segments").alias("i", "s")).select("transcript_id", (F.col("i") + 1).cast("long").alias("segment_no"), F.sha2("s.text", 256).alias("sha"), "s.t_start", "s.t_end")


def case_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and sums of each order's metered lines; money in exact decimals."""
    x = table(spark, folder, "lineitem")
    money = lambda c: F.sum(F.coalesce(F.col(c).cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))).cast("decimal(20,2)")
    return x.groupBy("l_orderkey").agg(F.count("*").alias("calls"), money("l_quantity").alias("units"), money("l_extendedprice").alias("cost"))


def usage_meter(spark: SparkSession, folder: str) -> DataFrame:
    """Metered values by interface; missing ones count as zero."""
    e = _events(spark, folder)
    return e.groupBy(F.col("event_type").alias("interface")).agg(F.count("*").alias("calls"), F.sum(F.coalesce(F.col("k").cast("long"), F.lit(0).cast("long"))).alias("units"), F.count_if(F.col("k").isNull()).alias("without"))


def tenant_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Messages by channel within one tenant's scope, opened by its name as capability, and in the scope without tenant."""
    opened = logs.capability(table(spark, folder, "tenant"), "tenant_name", " Copper Whisk Co ").select("tenant_id")
    m = table(spark, folder, "inbound_message")
    own = logs.scope(m, 3).join(opened, "tenant_id", "left_semi").groupBy("channel").agg(F.count("*").alias("messages"))
    return own.withColumn("scope", F.lit("tenant")).unionByName(logs.scope(m, None).groupBy("channel").agg(F.count("*").alias("messages")).withColumn("scope", F.lit("none")))


def registry_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Registered heads with the rows and distinct qualifiers they have, the largest first."""
    a = table(spark, folder, "emergent_attribute")
    return a.groupBy("head").agg(F.count("*").alias("rows"), F.count_distinct("qualifier").alias("qualifiers"), F.min("extracted_at").cast("timestamp_ntz").alias("first_seen")).orderBy(F.desc("rows"), "head")


QUERIES = {f.__name__: f for f in (
    current_projection, latest_order_per_customer, last_activity, first_writer_stamp, insert_if_absent, idempotent_replay, idempotency_keys, upsert_latest, upsert_coalesce, keyed_updates,
    guarded_transition, claim_ledger, outbound_claims, check_constraints, corrections_locked, json_member_set, citations, case_cost, usage_meter, tenant_scope, registry_listing,
)}

SQL = {
    "current_projection": f"""
        WITH e AS (SELECT *, {_K} AS k FROM events),
        x AS (SELECT user_id, k, max_by(value, event_id) AS value, max(event_id) AS event_id FROM e WHERE event_type <> 'error' GROUP BY ALL),
        c AS (SELECT user_id, k, max_by(value, event_id) AS value, max(event_id) AS event_id FROM e WHERE event_type = 'error' GROUP BY ALL)
        SELECT coalesce(c.user_id, x.user_id) AS user_id, coalesce(c.k, x.k) AS k, CASE WHEN c.event_id IS NOT NULL THEN c.value ELSE x.value END AS value,
               CASE WHEN c.event_id IS NOT NULL THEN 'correction' ELSE 'extraction' END AS origin, coalesce(c.event_id, x.event_id) AS event_id
        FROM x FULL JOIN c ON x.user_id = c.user_id AND x.k = c.k""",
    "latest_order_per_customer": """
        SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "last_activity": """
        SELECT c_custkey, greatest(TIMESTAMP '1995-01-01', coalesce(max(o_orderdate), TIMESTAMP '1995-01-01')) AS last_activity, count(o_orderkey) AS orders
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "first_writer_stamp": "SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "insert_if_absent": """
        WITH d AS (SELECT doc_id, source, sha256(text) AS sha FROM documents)
        SELECT sha, doc_id, source FROM d WHERE source <> 'email' AND sha NOT IN (SELECT sha FROM d WHERE source = 'email')
        QUALIFY row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1""",
    "idempotent_replay": "SELECT tenant_id, count(*) AS messages FROM (SELECT DISTINCT tenant_id, sender, sent_at, text FROM inbound_message) GROUP BY tenant_id",
    "idempotency_keys": "SELECT event_id, sha256(coalesce(event_type, '') || chr(31) || coalesce(user_id::VARCHAR, '') || chr(31) || coalesce(props, '')) AS idempotency_key FROM events",
    "upsert_latest": """
        SELECT tenant_id, order_id, object_id, upload_id, items FROM spike_bakery_objects
        QUALIFY row_number() OVER (PARTITION BY tenant_id, order_id ORDER BY object_id DESC) = 1""",
    "upsert_coalesce": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, order_id ORDER BY object_id) AS a, row_number() OVER (PARTITION BY tenant_id, order_id ORDER BY object_id DESC) AS z FROM spike_bakery_objects)
        SELECT o.tenant_id, o.order_id, coalesce(n.phone, o.phone) AS phone, coalesce(n.customer_name, o.customer_name) AS customer_name
        FROM r o JOIN r n ON o.tenant_id = n.tenant_id AND o.order_id = n.order_id AND o.a = 1 AND n.z = 1""",
    "keyed_updates": """
        SELECT c_custkey, c_mktsegment, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    "guarded_transition": """
        SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS status, count(*) AS orders FROM orders GROUP BY 1""",
    "claim_ledger": f"""
        WITH e AS (SELECT *, {_K} AS k FROM events)
        SELECT DISTINCT user_id, k FROM e WHERE NOT EXISTS (SELECT 1 FROM e d WHERE d.user_id = e.user_id AND d.k = e.k AND d.event_type = 'purchase')""",
    "outbound_claims": """
        SELECT case_id, sha256(case_id || chr(31) || text) AS claim, min(doc_id) AS doc_id FROM documents WHERE case_id IS NOT NULL GROUP BY 1, 2""",
    "check_constraints": """
        SELECT rule, count(*) AS broken FROM (
            SELECT 'quantity_range' AS rule FROM lineitem WHERE NOT l_quantity BETWEEN 1 AND 45
            UNION ALL SELECT 'discount_range' FROM lineitem WHERE NOT l_discount <= 0.08
            UNION ALL SELECT 'flag_enum' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
            UNION ALL SELECT 'tax_not_negative' FROM lineitem WHERE NOT l_tax >= 0) GROUP BY rule""",
    "corrections_locked": f"""
        WITH e AS (SELECT *, {_K} AS k FROM events)
        SELECT user_id, count(*) AS corrections FROM e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM e c WHERE c.event_type = 'purchase' AND c.user_id = e.user_id AND c.k = e.k) GROUP BY 1""",
    "json_member_set": f"SELECT event_type AS state, {_K} AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "citations": """
        SELECT transcript_id, i AS segment_no, sha256(segments[i].text) AS sha, segments[i].t_start AS t_start, segments[i].t_end AS t_end
        FROM (SELECT transcript_id, segments, unnest(range(1, len(segments) + 1)) AS i FROM transcript)""",
    "case_cost": """
        SELECT l_orderkey, count(*) AS calls, sum(coalesce(l_quantity::DECIMAL(12,2), 0))::DECIMAL(20,2) AS units, sum(coalesce(l_extendedprice::DECIMAL(12,2), 0))::DECIMAL(20,2) AS cost FROM lineitem GROUP BY 1""",
    "usage_meter": f"SELECT event_type AS interface, count(*) AS calls, sum(coalesce(({_K})::BIGINT, 0))::BIGINT AS units, count(*) FILTER (({_K}) IS NULL) AS without FROM events GROUP BY 1",
    "tenant_scope": "SELECT channel, count(*) AS messages, 'tenant' AS scope FROM inbound_message WHERE tenant_id = 3 GROUP BY 1",
    "registry_listing": "SELECT head, count(*) AS rows, count(DISTINCT qualifier) AS qualifiers, min(extracted_at) AS first_seen FROM emergent_attribute GROUP BY 1",
}
