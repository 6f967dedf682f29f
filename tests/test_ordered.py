"""Ordered operators against plain loops, with one key that has most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators.ordered import first_by, gap_sessions, latest_by, numbered, order_bucket, prefix_sum, quantiles, running_max, top_k, with_previous

DAY = 86_400


def rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["hot", "hot", "hot", "a", "b", None]), dt.datetime(2025, 1, 1) + dt.timedelta(hours=rng.choice([0, 1, 23, 24, 25, 49, rng.randrange(4000)])), i, rng.randrange(5)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bucket_rows", [1, 60, 100_000])
def test_numbers_sums_and_sessions(spark, seed, bucket_rows):
    data = rows(seed)
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, id long, v long").withColumn("_b", F.lit("clash"))
    want_n, want_s, want_g = {}, {}, {}
    for key in {r[0] for r in data}:
        total, session, last = 0, 0, None
        for i, (_, ts, rid, v) in enumerate(sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            total += v
            session += last is None or (ts - last).total_seconds() > DAY
            last = ts
            want_n[rid], want_s[rid], want_g[rid] = i, total, session
    df = df.drop("_b")
    assert {r.id: r.rn for r in numbered(df, ["k"], "ts", ["id"], bucket_rows=bucket_rows).collect()} == want_n
    assert {r.id: r.s for r in prefix_sum(df, ["k"], "ts", ["id"], F.col("v"), "s", bucket_rows).collect()} == want_s
    assert {r.id: r.session_no for r in gap_sessions(df, ["k"], "ts", ["id"], DAY, bucket_rows=bucket_rows).collect()} == want_g


def test_gap_is_inclusive(spark):
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", t, 1), ("a", t + dt.timedelta(days=1), 2), ("a", t + dt.timedelta(days=2, seconds=1), 3), ("a", None, 4)], "k string, ts timestamp_ntz, id long")
    assert sorted((r.id, r.session_no) for r in gap_sessions(df, ["k"], "ts", ["id"], DAY).collect()) == [(1, 1), (2, 1), (3, 2)]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "k string, ts timestamp_ntz, id long, v long")
    assert numbered(empty, ["k"], "ts", ["id"]).count() == 0
    assert gap_sessions(empty, ["k"], "ts", ["id"], DAY).count() == 0
    one = spark.createDataFrame([(None, None, 1, None)], empty.schema)
    assert numbered(one, [], "ts", ["id"]).first().rn == 1


def test_latest_first_and_top(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 5, "y"), (None, 1, "z"), ("a", 2, None)], "k string, seq long, v string")
    assert sorted(((r.k or ""), r.v) for r in latest_by(df, ["k"], ["seq"], ["v"]).collect()) == [("", "z"), ("a", None), ("b", "y")]
    assert first_by(df, ["k"], ["seq"], ["v"]).where("k = 'a'").first().v == "x"
    assert top_k(df, ["k"], [F.desc("seq")], 1).count() == 3


def test_buckets_stay_even_under_outliers_bursts_and_a_hot_key(spark):
    t = dt.datetime(2025, 1, 1)
    data = [("hot" if i % 10 else f"k{i}", t + dt.timedelta(seconds=i), i) for i in range(20_000)]
    data += [("hot", t + dt.timedelta(seconds=7), i) for i in range(20_000, 40_000)]  # half of all rows at one moment
    data += [("hot", dt.datetime(1970, 1, 1), 40_000), ("hot", dt.datetime(9999, 1, 1), 40_001), ("hot", None, 40_002)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, id long")
    sizes = [r["count"] for r in df.withColumn("b", order_bucket(df, "ts", ["id"], bucket_rows=500)).groupBy("k", "b").count().where("k = 'hot'").collect()]
    assert len(sizes) > 40 and max(sizes) < 2 * 38_000 / 60
    got = {r.id: r.rn for r in numbered(df, [], "ts", ["id"], bucket_rows=500).collect()}
    assert got == {r[2]: i for i, r in enumerate(sorted(data, key=lambda r: (r[1] is not None, r[1] or t, r[2])), 1)}


@pytest.mark.parametrize("bucket_rows", [1, 40, 100_000])
def test_running_maximum_previous_and_quantiles(spark, bucket_rows):
    data = rows(5)
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, id long, v long")
    top, prev = {}, {}
    for key in {r[0] for r in data}:
        most = last = None
        for _, _, rid, v in sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2])):
            top[rid], prev[rid] = most, last
            most, last = v if most is None else max(most, v), v
    assert {r.id: r.m for r in running_max(df, ["k"], "ts", ["id"], F.col("v"), "m", bucket_rows).collect()} == top
    assert {r.id: r.p and r.p.v for r in with_previous(df, ["k"], "ts", ["id"], ["v"], "p", bucket_rows).collect()} == prev
    found = quantiles(df.where("k IS NOT NULL"), ["k"], "v", {"mid": F.floor(F.col("n") / 2), "top": F.col("n") - 1}, bucket_rows).collect()
    for r in found:
        own = sorted(x[3] for x in data if x[0] == r.k)
        assert (r.n, r.mid, r.top) == (len(own), own[len(own) // 2], own[-1])
