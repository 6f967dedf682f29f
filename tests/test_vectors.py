"""Vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import registry, resolve, vectors


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in base[i % 12] + 0.25 * rng.normal(size=8)], i % 3) for i in range(150)]
    rows += [(200, [0.0] * 8, 0), (201, None, 1), (202, rows[0][1], 0)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>, label int").withColumn("g", F.lit("clash"))


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.dot(a, b) / n) if n else 0.0


def test_edges_and_components(table, monkeypatch):
    rows, df = table
    real = [r for r in rows if r[1] is not None]
    want = {(a[0], b[0]) for a in real for b in real if a[0] < b[0] and cos(a[1], b[1]) >= 0.8}
    monkeypatch.setattr(vectors, "BLOCK", 40)  # several blocks
    edges = vectors.similarity_edges(df, "id", "v", 0.8)
    assert {(r.id_a, r.id_b) for r in edges.collect()} == want
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(want):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.component for r in vectors.components(edges, df.select("id")).collect()}
    assert got == {i: find(i) for i in parent}


def test_long_chain_and_hub(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)], "id_a long, id_b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), *range(1000, 1100), 5000]], "id long")
    got = {r.id: r.component for r in vectors.components(chain, nodes).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1100)) and got[5000] == 5000
    assert vectors.components(chain.limit(0), nodes.limit(0)).count() == 0


def test_nearest(table, monkeypatch):
    rows, df = table
    monkeypatch.setattr(vectors, "BLOCK", 50)
    queries = df.where("id % 50 = 0")
    got = {}
    for r in vectors.nearest(queries, df, "id", "v", 3, within="label").collect():
        got.setdefault(r.id_a, {})[r["rank"]] = r.id_b
    for q in (r for r in rows if r[0] % 50 == 0 and r[1] is not None):
        others = sorted(((-cos(q[1], o[1]), o[0]) for o in rows if o[1] is not None and o[0] != q[0] and o[2] == q[2]))[:3]
        assert [round(-cos(q[1], next(o[1] for o in rows if o[0] == i)), 9) for i in (got[q[0]][k] for k in (1, 2, 3))] == [round(s, 9) for s, _ in others]
    assert vectors.nearest(queries.limit(0), df, "id", "v", 3).count() == 0


def test_cosine_and_margin(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]
    ranked = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 2), (4, 5, 0.7, 1)], "id_a long, id_b long, similarity double, rank int")
    assert {r.id_a: round(r.margin, 9) for r in resolve.top_margin(ranked).collect()} == {1: 0.1, 4: 0.7}


def test_bands_and_canonicals(spark):
    bands = spark.createDataFrame([(None,), (0.9,), (0.85,), (0.78,), (0.69,)], "s double")
    assert [r.b for r in bands.select(registry.dedup_band(F.col("s")).alias("b")).collect()] == ["seed", "merge", "merge", "adjudicate", "admit_new"]
    names = spark.createDataFrame([("h", "a", [1.0, 0.0], 1), ("h", "b", [0.99, 0.1], 2), ("h", "c", [0.0, 1.0], 3), ("g", "d", [1.0, 0.0], 4), (None, "e", [1.0, 0.0], 5), ("h", "f", None, 6)], "head string, name string, v array<double>, o long")
    got = {r.name: (r.canonical, r.method) for r in registry.canonicalise(names, "head", "name", "v", "o").collect()}
    assert got == {"a": ("a", "seed"), "b": ("a", "merge"), "c": ("c", "admit_new"), "d": ("d", "seed")}


@pytest.mark.parametrize("least", [0.7, 0.85])
def test_the_index_finds_nine_tenths_and_more(spark, least):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(60, 32))
    x = np.repeat(base, 20, 0) + 0.45 * rng.normal(size=(1200, 32))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    exact = {(r.id_a, r.id_b): r.similarity for r in vectors.similarity_edges(df, "id", "v", least).collect()}
    found = {(r.id_a, r.id_b): r.similarity for r in vectors.similarity_edges(df, "id", "v", least, recall=0.95).collect()}
    assert len(exact) > 1000 and set(found) <= set(exact)
    assert len(found) >= 0.95 * len(exact) and all(abs(found[k] - exact[k]) < 1e-9 for k in found)
    assert vectors.similarity_edges(df.limit(0), "id", "v", least, recall=0.95).count() == 0


def test_index_is_more_selective_for_nearer_pairs():
    (b1, t1), (b2, t2) = vectors.bands(0.7, 0.95), vectors.bands(0.9, 0.95)
    assert b2 > b1 and t1 <= 256 and t2 <= 256
    same = 1 - np.arccos(0.9) / np.pi
    assert 1 - (1 - same**b2) ** t2 >= 0.95
