"""Queries over conversations in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.ordered import gap_sessions, latest_by, numbered, running_max, with_previous
from caseloom.sources.tables import table

DAY = 86_400
REOPEN_DAYS = 4
NOW = "2027-01-01 00:00:00"


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "inbound_message").where("trim(sender) <> ''").select("tenant_id", "sender", "message_id", "received_at")
    return gap_sessions(m, ["tenant_id", "sender"], "received_at", ["message_id"], DAY)


def sessions_24h(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations of each sender: a pause of more than a day begins a new one."""
    s = _sessions(spark, folder)
    return s.groupBy("tenant_id", "sender", "session_no").agg(F.count("*").alias("messages"), F.min("message_id").alias("first_message"), F.min("received_at").cast("timestamp_ntz").alias("started"), F.max("received_at").cast("timestamp_ntz").alias("ended"))


def window_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions on all events, counted by user."""
    return event_decisions(spark, folder).groupBy("user_id", "decision").agg(F.count("*").alias("events"))


def event_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decision on each event of a user against the user's previous one: new, follow-up, reopened (within four days of a terminal event) or ambiguous. Events without a moment are left out."""
    e = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type").where("ts IS NOT NULL")
    p = with_previous(e, ["user_id"], "ts", ["event_id"], ["event_type", "ts"])
    last_type, last_ts = F.col("previous.event_type"), F.col("previous.ts")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last_ts.cast("timestamp"))) / 1_000_000
    decision = (
        F.when(F.col("previous").isNull(), "new_no_prior")
        .when((last_type == "error") & (gap > REOPEN_DAYS * DAY), "new_terminal")
        .when(last_type == "error", "classify_terminal")
        .when(gap <= DAY, "follow_up")
        .otherwise("classify_idle")
    )
    return p.select("user_id", "event_id", decision.alias("decision"))


def session_cases(spark: SparkSession, folder: str) -> DataFrame:
    """A case made on the first contact of each sender: its clock is the first message's."""
    m = table(spark, folder, "inbound_message").where("trim(sender) <> ''")
    return m.groupBy("tenant_id", "sender").agg(F.min("received_at").cast("timestamp_ntz").alias("first_contact"), F.min_by("channel", F.struct("received_at", "message_id")).alias("channel"), F.lit("created").alias("state"))


def late_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events that come later than a newer one: how late they are against the newest moment before them in order of arrival, by type."""
    e = table(spark, folder, "inbound_message").select("message_id", "tenant_id", F.unix_micros(F.col("received_at").cast("timestamp")).alias("u"))
    x = running_max(e, [], "message_id", [], F.col("u"), "newest")
    return x.where("u < newest").groupBy("tenant_id").agg(F.count("*").alias("late"), F.max(F.floor((F.col("newest") - F.col("u")) / 1_000_000)).alias("most_seconds"))


def pending_inbound(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose newest click is newer than their newest purchase: something waits to be worked off."""
    e = table(spark, folder, "events")
    a = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("inbound"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("processed"))
    return a.where("inbound IS NOT NULL AND (processed IS NULL OR inbound > processed)").select("user_id")


def liveness(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds since the last sign of each channel, against a stated now, and whether it is down."""
    m = table(spark, folder, "inbound_message")
    age = F.floor((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.max("received_at").cast("timestamp"))) / 1_000_000)
    return m.groupBy("channel").agg(age.alias("age_seconds"), (age > 60).alias("down"))


def message_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Position of every message in its tenant's stream."""
    m = table(spark, folder, "inbound_message").select("message_id", "tenant_id", "received_at")
    return numbered(m, ["tenant_id"], "received_at", ["message_id"], "position").select("message_id", "tenant_id", "position")


QUERIES = {f.__name__: f for f in (sessions_24h, window_decisions, event_decisions, session_cases, late_events, pending_inbound, liveness, message_numbers)}

_SESSIONS = """
    WITH m AS (SELECT {keys}, {id}, {ts} AS ts {more} FROM {table} WHERE {where}),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 24 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM m WINDOW w AS (PARTITION BY {keys} ORDER BY ts, {id})),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY ts, {id})::BIGINT AS session_no FROM g)
"""
_DECIDED = """
    WITH d AS (SELECT user_id, event_id, ts, lag(event_id) OVER w AS last_id, lag(event_type) OVER w AS last_type, lag(ts) OVER w AS last_ts FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    , x AS (SELECT user_id, event_id, CASE WHEN last_id IS NULL THEN 'new_no_prior' WHEN last_type = 'error' AND ts - last_ts > INTERVAL 96 HOURS THEN 'new_terminal'
    WHEN last_type = 'error' THEN 'classify_terminal' WHEN ts - last_ts <= INTERVAL 24 HOURS THEN 'follow_up' ELSE 'classify_idle' END AS decision FROM d)"""
SQL = {
    "sessions_24h": _SESSIONS.format(keys="tenant_id, sender", id="message_id", ts="received_at", more="", table="inbound_message", where="trim(sender) <> ''")
    + "SELECT tenant_id, sender, session_no, count(*) AS messages, min(message_id) AS first_message, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2, 3",
    "window_decisions": _DECIDED + " SELECT user_id, decision, count(*) AS events FROM x GROUP BY 1, 2",
    "event_decisions": _DECIDED + " SELECT user_id, event_id, decision FROM x",
    "session_cases": "SELECT tenant_id, sender, min(received_at) AS first_contact, arg_min(channel, (received_at, message_id)) AS channel, 'created' AS state FROM inbound_message WHERE trim(sender) <> '' GROUP BY 1, 2",
    "late_events": """
        WITH x AS (SELECT tenant_id, epoch_us(received_at) AS u, max(epoch_us(received_at)) OVER (ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM inbound_message)
        SELECT tenant_id, count(*) AS late, max((newest - u) // 1000000)::BIGINT AS most_seconds FROM x WHERE u < newest GROUP BY 1""",
    "pending_inbound": """
        SELECT user_id FROM (SELECT user_id, max(ts) FILTER (event_type = 'click') AS a, max(ts) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1) WHERE a IS NOT NULL AND (b IS NULL OR a > b)""",
    "liveness": f"""
        SELECT channel, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(received_at))) // 1000000 AS age_seconds, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(received_at))) // 1000000 > 60 AS down FROM inbound_message GROUP BY 1""",
    "message_numbers": "SELECT message_id, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY received_at, message_id) AS position FROM inbound_message",
}
