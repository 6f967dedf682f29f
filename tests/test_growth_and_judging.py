"""Promotion, curves, policies, resolution, calibration."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseloom.operators import calibration as cal
from caseloom.operators import registry, resolve, rules


def test_promotion_thresholds(spark):
    rows = [(f"c{i}", "fee", "late") for i in range(8)] + [(f"c{i}", "date", f"q{i}") for i in range(4)] + [(f"c{i}", "rare", "x") for i in range(2)] + [("c0", "fee", "late"), ("c1", None, "x"), ("c2", "", "x")]
    df = spark.createDataFrame(rows, "case_id string, head string, qualifier string")
    got = {(r.kind, r.head, r.qualifier, r.support) for r in registry.promote(df, "head", "qualifier", "case_id", 4, 8).collect()}
    assert got == {("head", "fee", None, 8), ("head", "date", None, 4), ("variant", "fee", "late", 8)}
    assert registry.promote(df, "head", "qualifier", "case_id", 4, 8, F.col("head") == "fee").where("head = 'fee'").count() == 0
    assert registry.promote(df.limit(0), "head", "qualifier", "case_id", 4, 8).count() == 0


def test_pooled_support_counts_cases_once(spark):
    df = spark.createDataFrame([("a", "c1"), ("as", "c1"), ("as", "c2"), ("b", "c9"), ("b", None)], "q string, case_id string")
    aliases = spark.createDataFrame([("as", "a")], "q string, canonical string")
    assert {r.canonical: r.support for r in registry.pooled_support(df, aliases, "q", "canonical", "case_id").collect()} == {"a": 2, "b": 1}


def test_curve_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(i, "a" if i < 4 else "b") for i in range(6)], "id long, name string")
    assert sorted(map(tuple, registry.new_names_curve(df, "name", "id", [], 2).collect())) == [(0, 1), (1, 0), (2, 1)]
    assert registry.hapax(df.withColumn("name", F.col("id").cast("string")), ["name"]).first().once == 6


def test_worklist(spark):
    cases = spark.createDataFrame([(i,) for i in range(10)], "id long")
    tried = spark.createDataFrame([(0,), (0,), (2,)], "id long")
    assert [r.id for r in registry.backfill_worklist(cases, tried, "id", ["id"], 3).collect()] == [1, 3, 4]


def test_policy(spark):
    with pytest.raises(ValueError):
        rules.parse_policy([{"id": "a", "when": {"x": "1"}}], ["x"])
    with pytest.raises(ValueError):
        rules.parse_policy([{"id": "a"}, {"id": "a"}], ["x"])
    with pytest.raises(ValueError):
        rules.parse_policy([{"id": "a", "when": {"z": "1"}}, {"id": "b"}], ["x"])
    with pytest.raises(ValueError):
        rules.parse_policy([{"id": "a", "then": {"hours": 0}}], ["x"])
    p = rules.parse_policy([{"id": "one", "when": {"x": "1", "y": ["a", "b"]}, "then": {"hours": 1.5}}, {"id": "rest", "then": {"hours": 72}}], ["x", "y"])
    df = spark.createDataFrame([("1", "a"), ("1", None), (None, "a"), ("1", "c")], "x string, y string")
    assert [r.i for r in df.select(rules.evaluate(p, "id").alias("i")).collect()] == ["one", "rest", "rest", "rest"]
    t = spark.createDataFrame([(dt.datetime(2025, 1, 1),)], "t timestamp_ntz").select(rules.due(F.col("t"), F.lit(1.5)).cast("string").alias("d")).first().d
    assert t == "2025-01-01 01:30:00"


def test_resolution_outcomes(spark):
    cols = "anchor string, ih long, phone string, ph long, agrees boolean"
    rows = [("a", 1, "p", 1, False), ("a", 1, "p", 1, True), ("a", 1, None, 0, False), ("a", 0, "p", 1, False), ("a", 2, None, 0, False), (None, 0, "p", 1, False), (None, 0, "p", 2, False), (None, 0, None, 0, False)]
    out = spark.createDataFrame(rows, cols).select(resolve.resolve_outcome(*[F.col(c) for c in ("anchor", "ih", "phone", "ph", "agrees")]).alias("o"))
    assert [r.o for r in out.collect()] == ["confirm", "silent", "silent", "confirm", "confirm", "silent", "confirm", "elicit"]


def test_profile_prefers_identifiers(spark):
    df = spark.createDataFrame([(i, f"BK-{i}", f"2025-01-0{i}", "+971501234567" if i < 3 else f"+97150000000{i}", "cake") for i in range(1, 5)], "id long, order_id string, at string, phone string, items string")
    cells = resolve.melt(df, "id", ["order_id", "at", "phone", "items"])
    prof = resolve.profile_fields(cells)
    assert {r.field for r in prof.where("is_key").collect()} == {"order_id", "at", "phone"}
    assert {r.field for r in resolve.external_ids(cells, prof, "id").collect()} == {"order_id"}
    assert resolve.profile_fields(cells.limit(0)).count() == 0


def test_calibration(spark):
    rows = [("f", "a", "a", 1.0)] * 10 + [("f", "b", "a", 1.0)] * 6 + [("f", "b", "b", 1.0)] * 4 + [("f", "c", "c", 1.0)] * 9 + [("f", None, "a", 1.0), ("f", "a", None, 1.0)]
    df = spark.createDataFrame(rows, "field string, predicted string, gold string, grounding double")
    assert {r.predicted: (r.n, r.reliability) for r in cal.reliability(df).collect()} == {"a": (10, 1.0), "b": (10, 0.4)}
    loo = cal.leave_one_out(df)
    want = {}
    labelled = [r for r in rows if r[1] and r[2]]
    for i, r in enumerate(labelled):
        peers = [o for j, o in enumerate(labelled) if j != i and o[1] == r[1]]
        want.setdefault((r[1], r[2]), sum(o[1] == o[2] for o in peers) / len(peers))
    assert {(r.predicted, r.gold): round(r.loo, 9) for r in loo.collect()} == {k: round(v, 9) for k, v in want.items()}
    tau = cal.select_tau(cal.accepted_curve(loo), 0.98).first()
    assert (tau.tau, tau.gate_met) == (1.0, True)
    never = cal.select_tau(cal.accepted_curve(loo.withColumn("ok", F.lit(0))), 0.98).first()
    assert (never.tau, never.gate_met) == (1.01, False)
    conf = spark.createDataFrame([("UNCLEAR", 0.9, 0.5, 1.0), ("x", 0.9, 0.5, 0.5), ("x", None, 0.5, 1.0), ("x", None, None, 0.3), (None, 0.9, 0.5, 1.0)], "v string, r double, d double, g double")
    assert [r.c for r in conf.select(cal.confidence(F.col("v"), F.col("r"), F.col("d"), F.col("g")).alias("c")).collect()] == [0.0, 0.45, 0.5, 0.3, 0.0]
    bounds = spark.createDataFrame([(0, 300), (4, 100), (0, 0)], "e long, n long").select(cal.error_bound(F.col("e"), F.col("n")).alias("b")).collect()
    assert [r.b for r in bounds] == [0.01, 0.08, None]
