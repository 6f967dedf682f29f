"""Streams over bounded input equal the batch operators."""

import datetime as dt

from pyspark.sql import functions as F

from caseloom.operators.ordered import gap_sessions
from caseloom.streaming import messages as m

T = dt.datetime(2025, 1, 1)
SCHEMA = "sender string, ts timestamp, id long, text string, state string"


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_sessions(spark, tmp_path):
    hours = [0, 1, 25, 49.5, 60, 200]
    rows = [("a", T + dt.timedelta(hours=h), i, "x", "open") for i, h in enumerate(hours)] + [("b", T, 99, "x", "open")]
    got = run(m.sessions(written(spark, tmp_path, rows), ["sender"], "ts"), "s1", "complete")
    batch = gap_sessions(spark.createDataFrame(rows, SCHEMA), ["sender"], "ts", ["id"], 86_400).groupBy("sender", "session_no").agg(F.count("*").alias("n"))
    assert sorted((r.sender, r.messages) for r in got.collect()) == sorted((r.sender, r.n) for r in batch.collect())


def test_once_and_dispatch(spark, tmp_path):
    rows = [("a", T, 1, "x", "open"), ("a", T, 2, "x", "open"), ("b", T, 3, "x", "open")]
    stream = written(spark, tmp_path, rows)
    assert run(m.once(stream, ["sender", "text"], "ts"), "s2").count() == 2
    for k in range(2):  # a replay from the start writes nothing more
        m.dispatch(stream, str(tmp_path / "out"), ["sender", "text"], ["id"], str(tmp_path / f"cp{k}")).awaitTermination()
    assert sorted((r.sender, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1), ("b", 3)]


def test_rate_limit_counts_accepted_only(spark, tmp_path):
    rows = [("a", T + dt.timedelta(seconds=s), s, "x", "open") for s in (0, 1, 2, 3, 61, 62)]
    got = run(m.rate_limited(written(spark, tmp_path, rows), "sender", "ts", 2, 60), "s3").orderBy("u").collect()
    assert [r.accepted for r in got] == [True, True, False, False, True, True]


def test_windowing_with_terminal_states(spark, tmp_path):
    day = dt.timedelta(days=1)
    rows = [("a", T, 1, "x", "open"), ("a", T + day, 2, "x", "open"), ("a", T + 2 * day + dt.timedelta(seconds=1), 3, "x", "closed"), ("a", T + 3 * day, 4, "x", "closed"), ("a", T + 9 * day, 5, "x", "open")]
    got = run(m.windowed(written(spark, tmp_path, rows), ["sender"], "ts", "state", ["closed"]), "s4").orderBy("u").collect()
    assert [r.decision for r in got] == ["new_no_prior", "follow_up", "classify_idle", "classify_terminal", "new_terminal"]


def test_retries_end_in_a_terminal_state():
    waits, calls = [], []

    def flaky(good_at):
        calls.append(1)
        if len(calls) < good_at:
            raise ValueError("no")
        return len(calls)

    assert m.with_retries(lambda: flaky(3), sleep=waits.append) == ("done", 3) and waits == [30, 60]
    calls.clear(), waits.clear()
    state, error = m.with_retries(lambda: flaky(99), sleep=waits.append)
    assert state == "failed" and str(error) == "no" and len(calls) == 4 and waits == [30, 60, 90]


def test_scans_run_in_order_and_pools_are_left(spark, tmp_path):
    seen = []
    q = m.scans(written(spark, tmp_path, [("a", T, 1, "x", "open")]), [lambda df, b: seen.append(("dedup", df.count())), lambda df, b: seen.append(("promote", df.count()))], str(tmp_path / "cp"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert seen[:2] == [("dedup", 1), ("promote", 1)]
    assert m.in_pool(spark, "low", lambda: spark.sparkContext.getLocalProperty("spark.scheduler.pool")) == "low"
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_state_expires(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    add([("a", T, 1, "x", "open")])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = m.windowed(stream, ["sender"], "ts", "state", ["closed"], keep_seconds=86_400, late="1 hour").writeStream.format("memory").queryName("s5").outputMode("append").start()
    for days in (10, 11, 12):  # other senders move the watermark on
        q.processAllAvailable()
        add([("b", T + dt.timedelta(days=days), days, "x", "open")])
    q.processAllAvailable()
    add([("a", T + dt.timedelta(days=12, hours=1), 99, "x", "open")])
    q.processAllAvailable()
    q.stop()
    assert [r.decision for r in spark.table("s5").where("key = 'a'").orderBy("u").collect()] == ["new_no_prior", "new_no_prior"]
