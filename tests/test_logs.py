"""Logs and writes: replays change nothing, corrections win, constraints hold."""

import pytest
from pyspark.sql import functions as F

from caseloom.operators import logs
from caseloom.sources import sinks

LOG = "case_id string, field string, seq long, value string"


def test_projection(spark):
    e = spark.createDataFrame([("c", "amount", 1, "10"), ("c", "amount", 3, "12"), ("c", "date", 2, "may"), ("d", "amount", 9, "7")], LOG)
    c = spark.createDataFrame([("c", "amount", 2, None), ("c", "only", 5, "z")], LOG)
    keys = ["case_id", "field"]
    want = [("c", "amount", None, "correction"), ("c", "date", "may", "extraction"), ("c", "only", "z", "correction"), ("d", "amount", "7", "extraction")]
    for x in (e, e.orderBy(F.desc("seq")), e.unionByName(e)):  # order and replays do not matter
        got = logs.project_current(x, c, keys, "seq", "value").select("case_id", "field", "value", "origin").collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert logs.project_current(e.limit(0), c.limit(0), keys, "seq", "value").count() == 0


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([(1, "k"), (2, "l"), (None, "m")], "tenant_id long, embed_key string")
    assert logs.scope(df, None).count() == 0 and logs.scope(df, 1).count() == 1 and logs.scope_all(df).count() == 3
    assert logs.capability(df, "embed_key", " k ").count() == 1 and logs.capability(df, "embed_key", " ").count() == 0 and logs.capability(df, "embed_key", None).count() == 0


def test_insert_upsert_set(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, version long, v string")
    new = spark.createDataFrame([("a", 2, None), ("c", 1, "z"), ("c", 1, "z"), ("b", 0, "old")], old.schema)
    assert [r.k for r in logs.insert_if_absent(old, new, ["k"], ["version"]).collect()] == ["c"]
    got = {r.k: r.v for r in logs.upsert(old, new, ["k"], "version").collect()}
    assert got == {"a": None, "b": "y", "c": "z"}
    assert {r.k: r.v for r in logs.upsert_coalesce(old, new.dropDuplicates(), ["k"], ["v"]).collect()} == {"a": "x", "b": "old", "c": "z"}
    assert {r.k: r.v for r in logs.set_columns(old, new.where("k = 'a'"), ["k"], ["v"]).collect()} == {"a": "x", "b": "y"}


def test_keys_rules_ledger_json(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "ab", "c")], "id long, x string, y string")
    keys = [r.k for r in df.select(logs.idempotency_key(F.col("x"), F.col("y")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 64
    bad = logs.violations(df, "id", {"y_filled": F.col("y") != "", "x_short": F.length("x") < 2}).collect()
    assert sorted((r.id, r.rule) for r in bad) == [(2, "y_filled"), (3, "x_short")]
    ledger = spark.createDataFrame([(1, "done"), (2, "failed")], "id long, status string")
    assert sorted(r.id for r in logs.unclaimed(df, ledger, ["id"]).collect()) == [2, 3]
    j = spark.createDataFrame([('{"b":"1","a":"2"}',), (None,), ("broken",)], "doc string")
    assert [r.d for r in j.select(logs.json_set(F.col("doc"), "b", F.lit("9")).alias("d")).collect()] == ['{"a":"2","b":"9"}', '{"b":"9"}', '{"b":"9"}']
    assert spark.range(1).select(logs.guarded(F.lit("open"), ["open"], F.lit("failed")).alias("s")).first().s == "failed"


def test_write_once_and_rebuild(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "sha string, id long")
    store = str(tmp_path / "store")
    for _ in range(2):
        sinks.append_absent(df, store, ["sha"], ["id"])
    assert sorted(map(tuple, spark.read.parquet(store).select("sha", "id").collect())) == [("a", 1), ("b", 3)]
    parts = str(tmp_path / "parts")
    sinks.rebuild(spark.createDataFrame([(1, "x"), (2, "y")], "tenant_id long, v string"), parts)
    later = spark.createDataFrame([(2, "z")], "tenant_id long, v string")
    for scope, left in (([2], [(1, "x"), (2, "z")]), ([1, 2], [(2, "z")])):  # a tenant without rows loses its old ones
        sinks.rebuild(later, parts, scope=scope)
        assert sorted(map(tuple, spark.read.parquet(parts).select("tenant_id", "v").collect())) == left
    log = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_only(later, log)
    assert spark.read.parquet(log).count() == 2
    with pytest.raises(ValueError, match="columns"):
        sinks.append_only(df, log)
    sinks.write_register(df, str(tmp_path / "reg"), ["id", "sha"], ["id"])
    assert spark.read.csv(str(tmp_path / "reg"), header=True).count() == 3
    sinks.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    sheet = sinks.label_sheet(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "kept")], "id long, gold string"), "id", ["gold"])
    assert sorted(map(tuple, sheet.collect())) == [(1, "kept"), (2, "")]
    with pytest.raises(Exception):
        sinks.label_sheet(df, df, "nothing", ["gold"]).collect()
