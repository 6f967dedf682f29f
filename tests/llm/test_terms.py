"""Term frequencies against counters, and bitmaps against sets."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import term_bitmaps as tb


@pytest.mark.parametrize("n", [0, 1, 5, tb.DENSE, tb.DENSE + 1, tb.CONTAINER])
def test_containers(n):
    rng = np.random.default_rng(n)
    a, b = (np.sort(rng.choice(tb.CONTAINER, n, replace=False)) for _ in range(2))
    ea, eb = tb.encode(a), tb.encode(b)
    assert (tb.decode(ea) == a).all() and tb.cardinality(ea) == n
    assert set(tb.decode(tb.union([ea, eb]))) == set(a) | set(b) and len(ea) <= 1 + tb.CONTAINER // 8
    assert tb.union([ea, ea]) == ea


@pytest.mark.parametrize("buckets", [1, 16])
def test_frequencies(spark, buckets, monkeypatch):
    monkeypatch.setattr(tb, "CONTAINER", 64)  # several containers in a bucket
    monkeypatch.setattr(tb, "DENSE", 8)
    rng = random.Random(buckets)
    rows = [(rng.choice(["hot"] * 5 + [f"c{rng.randrange(300)}", None]), rng.choice(["Amount", " amount!", "Fee", "", None, f"q{rng.randrange(200)}"])) for _ in range(3000)]
    df = spark.createDataFrame([(c, t, 1) for c, t in rows], "case_id string, head string, n int")
    occurrences, records = Counter(), defaultdict(set)
    for c, t in rows:
        term = "_".join(x for x in "".join(ch if ch.isalnum() else " " for ch in (t or "").lower()).split())
        if term:
            occurrences[term] += 1
            if c is not None:
                records[term].add(c)
    bits = tb.term_bitmaps(df, "case_id", {"head": tb.normal_term(F.col("head"))}, buckets)
    got = {r.term: (r.occurrences, r.records) for r in tb.term_frequencies(bits).collect()}
    assert got == {t: (n, len(records[t])) for t, n in occurrences.items()}
    keys = [(r.term, r.container) for r in bits.collect()]
    assert len(keys) == len(set(keys))
    total = df.agg(F.count_distinct("case_id").alias("records_total"))
    marks = {r.term: r.mark for r in tb.marked(tb.term_frequencies(bits), total, 3, 0.2).collect()}
    n = total.first()[0]
    assert marks == {t: "rare" if len(records[t]) < 3 else "common" if len(records[t]) > 0.2 * n else None for t in occurrences}
    assert tb.term_frequencies(tb.term_bitmaps(df.limit(0), "case_id", {"head": F.col("head")})).count() == 0


def test_partial_bitmaps_merge_across_batches():
    import pandas as pd

    def parts(rows):
        return pd.DataFrame(rows, columns=["field_name", "term", "container", "position", "n"])

    first = list(tb.partial_bitmaps(iter([parts([("f", "a", 0, 5.0, 2), ("f", "a", 0, 5.0, 1), ("f", "b", 1, 7.0, 1)]), parts([("f", "a", 0, 9.0, 4), ("f", "a", -1, None, 3)])])))
    assert [len(p) for p in first] == [2, 2]
    together = pd.concat(first).sort_values(["field_name", "term", "container"])
    merged = pd.concat(tb.merge_bitmaps(iter([together.iloc[:2], together.iloc[2:]])))  # the key goes on in the next batch
    got = {(r.term, r.container): (r.occurrences, list(tb.decode(r.bits))) for r in merged.itertuples()}
    assert got == {("a", -1): (3, []), ("a", 0): (7, [5, 9]), ("b", 1): (1, [7])}
    assert list(tb.merge_bitmaps(iter([]))) == []
