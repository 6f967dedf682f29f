"""Mixing: shares, repeats, splits and disjoint draws."""

import random
from collections import Counter

import numpy as np
import pytest

from caseloom.llm import mixing as M
from caseloom.llm.tokens import TOKENIZER_FOLDER, with_tokens

TARGETS = "source string, target_share double, max_repeats int"


def test_split_tree_is_exact():
    rng = np.random.default_rng(1)
    counts = np.array([1000, 37, 0, 5])
    q = M.split_quotas(counts, 13, rng)
    assert (q.sum(0) == counts).all() and q.sum(1).max() - q.sum(1).min() <= 4
    draws = np.array([M.split_quotas(np.array([60, 20]), 4, np.random.default_rng(s))[0] for s in range(400)])
    assert abs(draws[:, 0].mean() - 15) < 0.5  # each shard expects its part of every source


def test_slots_take_what_is_wanted():
    rng = np.random.default_rng(2)
    for wanted in (17, 900, 4321):
        sizes = {b: int(n) for b, n in enumerate(rng.integers(0, 50, 64))}
        plan = M.slots(sizes, wanted, 3)
        assert sum(sizes[b] if part < 0 else part for b, _, part in plan) == wanted
        assert len({(b, r) for b, r, _ in plan}) == len(plan) and M.slots(sizes, wanted, 3) == plan
    assert M.slots({}, 5, 1) == [] and M.slots({1: 0}, 5, 1) == []


def test_shards_follow_the_total(spark):
    _, items = make(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    out = M.mix(items, targets, "doc_id", "tokens", "source", "target_share", "max_repeats", total=60_000.0, blocks=8, shard_tokens=1_000).collect()
    assert len({r.shard for r in out}) == 60 and abs(sum(r["size"] for r in out) - 60_000) < 400


def make(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaaaaaaabbc"), rng.randrange(1, 200), "clash", 1) for i in range(n)]
    rows += [(None, "a", 5, "", 1), (n + 1, None, 5, "", 1), (n + 2, "a", 0, "", 1), (n + 3, "a", None, "", 1), (n + 4, "untargeted", 9, "", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, tokens long, shard string, block int")


@pytest.mark.parametrize("total", [None, 60_000.0, 5e6])
def test_operator(spark, total):
    rows, items = make(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("empty", 0.1, 2), (None, 0.1, 1), ("zero", 0.0, 1)], TARGETS)
    mixed = M.mix(items, targets, "doc_id", "tokens", "source", "target_share", "max_repeats", total=total, blocks=64)
    out = mixed.collect()
    size = {r[0]: (r[1], r[2]) for r in rows if r[0] is not None and r[1] in ("a", "b", "c") and r[2]}
    assert all(size[r.item_id] == (r.source, r["size"]) for r in out)
    times = Counter((r.source, r.item_id) for r in out)
    assert all(v <= {"a": 1, "b": 2, "c": 3}[s] for (s, _), v in times.items())
    assert len({(r.item_id, r.repeat_no) for r in out}) == len(out) and len({(r.shard, r.position) for r in out}) == len(out)
    got = Counter()
    for r in out:
        got[r.source] += r["size"]
    have = Counter()
    for s, n in size.values():
        have[s] += n
    goals = {s: M.Target(x, k, have[s]) for s, x, k in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3))}
    want = M.needs(goals, M.reachable_total(goals) if total is None else total)
    for s in "abc":
        assert abs(got[s] - want[s]) <= 200
    if total is None or total < 1e5:
        assert all(abs(got[s] / sum(got.values()) - x) < 0.005 for s, x in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    else:
        assert got["a"] == have["a"] and got["c"] == 3 * have["c"]  # as far as the repeats allow
    report = {r.source: r for r in M.share_report(mixed, targets, "source", "target_share", "max_repeats").collect()}
    assert report["empty"].tokens == 0 and report["a"].tokens == got["a"]


def test_empty_and_repeatable(spark):
    _, items = make(spark, 300)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    args = ("doc_id", "tokens", "source", "target_share", "max_repeats")
    assert M.mix(items.limit(0), targets, *args).count() == 0 and M.mix(items, targets.limit(0), *args).count() == 0
    one, two = (sorted(map(tuple, M.mix(items, targets, *args, blocks=16).collect())) for _ in range(2))
    assert one == two


def test_token_counts(spark):
    from pathlib import Path

    if not Path(TOKENIZER_FOLDER).exists():
        pytest.skip("no tokenizer files here")
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "word " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in with_tokens(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 50_000
