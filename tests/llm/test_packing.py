"""Packing: nothing lost, nothing over, nothing cut without need, little left over."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from caseloom.llm import packing as P

KINDS = "container_kind string, capacity_tokens int"


@pytest.mark.parametrize("seed", range(5))
def test_fullest_is_the_best_subset(seed):
    rng = random.Random(seed)
    items = [rng.randrange(1, 40) for _ in range(9)]
    counts, room = Counter(items), rng.randrange(20, 120)
    best = max((sum(c) for r in range(10) for c in combinations(items, r) if sum(c) <= room), default=0)
    total, used = P.fullest(counts, sorted(counts, reverse=True), room)
    assert total == best == sum(n * k for n, k in used.items()) and all(k <= counts[n] for n, k in used.items())


def test_patterns_use_everything_up():
    rng = random.Random(1)
    counts = Counter(rng.randrange(1, 512) for _ in range(5000))
    plan = P.minimum_bin_slack(dict(counts), 512)
    used = Counter()
    for pattern, times in plan:
        assert sum(n * k for n, k in pattern.items()) <= 512
        for n, k in pattern.items():
            used[n] += k * times
    assert used == counts and sum(n * c for n, c in counts.items()) / (512 * sum(t for _, t in plan)) > 0.985
    assert P.minimum_bin_slack({}, 10) == [] and P.minimum_bin_slack({10: 3}, 10) == [({10: 1}, 3)]


def test_operator(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([7, 7, 7, rng.randrange(1, 300), rng.randrange(1, 5000)]) for i in range(800)}
    rows = [(i, n, "clash") for i, n in sizes.items()] + [(900, 0, ""), (901, None, ""), (902, -3, ""), (None, 5, ""), (903, 512, ""), (904, 1024, "")]
    items = spark.createDataFrame(rows, "doc_id long, tokens long, container_id string")
    kinds = spark.createDataFrame([("small", 512), ("large", 4096), ("none", 0), (None, None), ("small", 512)], KINDS)
    sizes |= {903: 512, 904: 1024}
    out = P.pack(items, kinds, "doc_id", "tokens", "container_kind", "capacity_tokens", salts=3).collect()
    for kind, cap in (("small", 512), ("large", 4096)):
        own = [r for r in out if r.container_kind == kind]
        fill, parts = Counter(), defaultdict(list)
        for r in own:
            fill[r.container_id] += r.length
            parts[r.item_id].append((r.start, r.length, r.piece_no))
        assert max(fill.values()) <= cap
        assert set(parts) == set(sizes)
        for i, pieces in parts.items():
            at = 0
            for no, (start, length, piece) in enumerate(sorted(pieces), 1):
                assert start == at and piece == no
                at += length
            assert at == sizes[i] and (len(pieces) == 1 or sizes[i] > cap) and len(pieces) == -(-sizes[i] // cap)
        assert sum(fill.values()) / (cap * len(fill)) > 0.97
    assert {r.container_kind for r in out} == {"small", "large"}
    report = {r.container_kind: r for r in P.fill_report(P.pack(items, kinds, "doc_id", "tokens", "container_kind", "capacity_tokens"), kinds.dropDuplicates(), "container_kind", "capacity_tokens").collect()}
    assert report["small"].used == sum(sizes.values()) and report["small"].most <= 512
    assert P.pack(items.limit(0), kinds, "doc_id", "tokens", "container_kind", "capacity_tokens").count() == 0


def test_repeated_items_never_share_a_place(spark):
    items = spark.createDataFrame([("a", 1000)] * 2 + [("b", 512)] * 3 + [("c", 200)] * 5, "id string, tokens int")
    kinds = spark.createDataFrame([("k", 512), ("wide", 700)], "kind string, cap int")
    out = P.pack(items, kinds, "id", "tokens", "kind", "cap").collect()
    used, total = {}, {}
    for r in out:
        used[r.container_kind, r.container_id] = used.get((r.container_kind, r.container_id), 0) + r.length
        total[r.container_kind] = total.get(r.container_kind, 0) + r.length
    assert all(n <= {"k": 512, "wide": 700}[k] for (k, _), n in used.items())
    assert total == {"k": 4536, "wide": 4536}
