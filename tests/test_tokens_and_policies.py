"""Signed tokens against the standard library, policies from documents, provenance, and resumable batches."""

import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from caseloom.functions import text as t
from caseloom.operators import provenance, registry, resolve, rules


@pytest.mark.parametrize("secret", [b"short", b"k" * 64, b"a secret longer than the block of the hash " * 3])
def test_tokens(spark, secret):
    url = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    payloads = ["a:b", "", "täglich", "x" * 200]
    want = [f"{url(p.encode())}.{url(hmac.new(secret, p.encode(), hashlib.sha256).digest())}" for p in payloads]
    df = spark.createDataFrame([(p, w) for p, w in zip(payloads, want)], "p string, w string")
    assert [r.t for r in df.select(t.signed_token(F.col("p"), secret).alias("t")).collect()] == want
    assert [r.p for r in df.select(t.token_payload(F.col("w"), secret).alias("p")).collect()] == payloads
    bad = spark.createDataFrame([(want[0] + "x",), (want[0].replace(".", "!"),), ("",), (None,), ("%%%.x",), (f"{url(b'other')}.{want[0].partition('.')[2]}",)], "w string")
    assert [r.p for r in bad.select(t.token_payload(F.col("w"), secret).alias("p")).collect()] == [None] * 6
    with pytest.raises(ValueError):
        t.signed_token(F.col("p"), b"")


def test_policies_from_documents():
    good = "version: '3'\nrules:\n- id: hot\n  when: {level: [high, top]}\n  priority: P1\n  sla_hours: 4.5\n- id: rest\n  priority: P4\n  sla_hours: 72\n"
    policy = rules.load_policy(good, ["level"], ["P1", "P4"])
    assert [r.id for r in policy] == ["hot", "rest"] and policy[0].then == {"priority": "P1", "hours": 4.5} and list(policy[0].when["level"]) == ["high", "top"]
    for broken in ("a: [", "just text", "rules: 3", good.replace("id: rest", "id: hot"), good.replace("level", "mood"), good.replace("72", "0"), good.replace("72", "true"), good.replace("P4", "P9"), good.replace("id: rest", "id: rest\n  when: {level: [low]}")):
        with pytest.raises(ValueError):
            rules.load_policy(broken, ["level"], ["P1", "P4"])


def test_spans_are_sorted_clamped_and_disjoint(spark):
    rows = [([(5, 9), (-3, 2), (8, 12), (1, 4), (11, 99), (30, 40), (6, 6)], 20), ([], 5), (None, 5)]
    df = spark.createDataFrame(rows, "s array<struct<start:int,end:int>>, n int")
    got = [[tuple(x) for x in r.d] for r in df.select(provenance.disjoint_spans(F.col("s"), F.col("n")).alias("d")).collect()]
    assert got == [[(0, 2), (5, 9), (11, 20)], [], []]


def test_values_are_located_in_their_case_only(spark):
    values = spark.createDataFrame([("a", " Pump "), ("a", "valve"), ("a", None), ("a", "  "), (None, "pump"), ("b", "pump"), ("a", "Pump")] + [("a", f"none{i}") for i in range(1200)], "c string, v string")
    docs = spark.createDataFrame([("a", 2, "the valve and the PUMP"), ("a", 1, "first a pump"), ("a", 3, None), ("b", 9, "nothing"), (None, 4, "pump")], "c string, d long, text string")
    got = sorted(tuple(r) for r in provenance.located_values(values, docs, "c", "v", "d", "text").collect())
    assert got == [("a", "Pump", 1, 8, 12), ("a", "valve", 2, 17, 22)]
    assert provenance.located_values(values.limit(0), docs, "c", "v", "d", "text").count() == 0


def test_batches_go_on_where_they_ended(spark):
    cases = spark.createDataFrame([(i,) for i in range(5)], "id long")
    attempts = spark.createDataFrame([], "id long, marker string")
    seen = []
    for _ in range(4):
        batch = registry.backfill_batch(cases, attempts, "id", ["id"], 2)
        rows = sorted(tuple(r) for r in batch.collect())
        seen.append(rows)
        attempts = spark.createDataFrame(attempts.collect() + registry.backfill_marks(batch, cases.where("id % 2 = 0"), "id").collect(), attempts.schema)
    assert seen == [[(0, True), (1, True)], [(2, True), (3, True)], [(4, False)], []]
    assert sorted(map(tuple, attempts.collect())) == [(i, "absent" if i % 2 else "found") for i in range(5)]


def test_names_resolve_by_margin(spark):
    records = spark.createDataFrame([(1, 1, "Ottoline Brackenbury"), (2, 1, "Thaddeus Quill"), (3, 1, "Marina Costa"), (4, 1, "Marina Costa"), (5, 2, "Ottoline Brackenbury")], "id long, t long, n string")
    probes = spark.createDataFrame([(10, 1, "ottoline brackenburry"), (11, 1, "Marina Costa"), (12, 1, "Zebedee Ng"), (13, 1, None), (14, 1, " ")], "id long, t long, n string")
    got = {r.id: (r.mode, r.bound) for r in resolve.resolve_by_name(probes, records, "id", "t", "n").collect()}
    assert got == {10: ("silent", 1), 11: ("confirm", None), 12: ("elicit", None), 13: ("elicit", None), 14: ("elicit", None)}


def test_fields_are_masked_wholly_by_name(spark):
    df = spark.createDataFrame([("ssn", "anything"), ("note", "mail a@b.example"), ("ssn", None)], "n string, v string")
    assert [r.m for r in df.select(t.masked_field(F.col("n"), F.col("v")).alias("m")).collect()] == ["«redacted»", "mail «redacted:email»", None]
