"""Structured Streaming twins of the batch operators on messages."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caseloom.sources.sinks import append_absent


def sessions(messages: DataFrame, keys: list[str], ts: str, gap: str = "24 hours", late: str = "7 days") -> DataFrame:
    """Conversations by key with a pause of ``gap`` at most; exactly the gap still belongs together. State is dropped once the watermark passes."""
    w = F.session_window(ts, gap)
    out = messages.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("messages"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
    return out.select(*keys, "messages", "started", "ended")


def once(messages: DataFrame, keys: list[str], ts: str, late: str = "7 days") -> DataFrame:
    """Each message key once within the watermark."""
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def _expires(state: GroupState, newest_us: int, keep_seconds: int) -> None:
    """Lets a key's state go once the watermark is ``keep_seconds`` past its newest row."""
    state.setTimeoutTimestamp(max(newest_us // 1000 + keep_seconds * 1000, state.getCurrentWatermarkMs() + 1))


def rate_limited(hits: DataFrame, key: str, ts: str, limit: int, window_seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, ts, accepted): at most ``limit`` *accepted* hits of a key in a sliding window; rejected ones do not count.

    The state of a key is the moments it was accepted at, ``limit`` at most; it
    goes once the watermark has passed the window.
    """
    span = window_seconds * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("u", kind="stable")
        accepted = []
        for u in rows["u"]:
            taken = [x for x in taken if x > u - span]
            ok = len(taken) < limit
            accepted.append(ok)
            if ok:
                taken.append(int(u))
        state.update((taken,))
        _expires(state, int(rows["u"].max()), window_seconds)
        yield pd.DataFrame({"key": rows["k"], "u": rows["u"], "accepted": accepted})

    named = hits.withWatermark(ts, late).select(F.col(key).cast("string").alias("k"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("u"))
    return named.groupBy("k").applyInPandasWithState(step, "key string, u long, accepted boolean", "taken array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed(messages: DataFrame, keys: list[str], ts: str, state: str, terminal: list[str], idle_seconds: int = 86_400, reopen_seconds: int = 345_600, keep_seconds: int = 30 * 86_400, late: str = "7 days") -> DataFrame:
    """(key, u, decision) of every message against its key's last one: new, follow_up, or classify in doubt; a terminal state reopens for ``reopen_seconds``. A key without messages for ``keep_seconds`` is forgotten, and its next one is new."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        last, ended = held.get if held.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values("u", kind="stable")
        out = []
        for u, end in zip(rows["u"], rows["end"]):
            gap = None if last is None else (u - last) / 1_000_000
            if gap is None:
                out.append("new_no_prior")
            elif ended:
                out.append("new_terminal" if gap > reopen_seconds else "classify_terminal")
            else:
                out.append("follow_up" if abs(gap) <= idle_seconds else "classify_idle")
            if last is None or u >= last:
                last, ended = int(u), bool(end)
        held.update((last, ended))
        _expires(held, last, keep_seconds)
        yield pd.DataFrame({"key": rows["k"], "u": rows["u"], "decision": out})

    named = messages.withWatermark(ts, late).select(F.concat_ws("\u001f", *keys).alias("k"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("u"), F.col(state).isin(*terminal).alias("end"))
    return named.groupBy("k").applyInPandasWithState(step, "key string, u long, decision string", "last long, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def dispatch(messages: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, name: str = "dispatch"):
    """Writes each message key once to a store, whatever is replayed; a batch that is retried replaces what its first attempt wrote. Returns the started query."""
    write = lambda df, batch: append_absent(df, path, keys, order, f"{name}-{batch}")
    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_retries(step, attempts: int = 4, wait_seconds: float = 30.0, sleep=time.sleep):  # noqa: ANN001
    """Runs a step up to ``attempts`` times, waiting ``wait_seconds`` times the number of failures so far; gives ("done", result), or ("failed", last error) as the terminal state."""
    error: Exception | None = None
    for k in range(1, attempts + 1):
        try:
            return "done", step()
        except Exception as e:  # noqa: BLE001
            error = e
            if k < attempts:
                sleep(wait_seconds * k)
    return "failed", error


def scans(messages: DataFrame, steps: list, checkpoint: str, every: str = "30 minutes"):
    """Runs maintenance steps one after the other, in the order given, on every tick of a stream; each gets the batch and its number. Returns the started query."""

    def tick(df: DataFrame, batch: int) -> None:
        for step in steps:
            step(df, batch)

    return messages.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def in_pool(spark: SparkSession, pool: str, work):  # noqa: ANN001
    """Runs work in a scheduler pool of its own, so that low-priority work does not hold up the rest; the session's scheduler mode must be FAIR for pools to count."""
    sc = spark.sparkContext
    before = sc.getLocalProperty("spark.scheduler.pool")
    sc.setLocalProperty("spark.scheduler.pool", pool)
    try:
        return work()
    finally:
        sc.setLocalProperty("spark.scheduler.pool", before)
