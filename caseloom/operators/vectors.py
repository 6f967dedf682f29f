"""Similarity of vectors: exact neighbours, edges and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.plans.sizing import cut

#: Vectors of one block; blocks of queries meet blocks of the rest.
BLOCK = 2048
MOST_IN_GROUP = 200_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), zero, lambda s, x: s + x))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def _unit(rows: list) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in rows])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _blocks(df: DataFrame, key: str, vector: str, within: str | None, count: int) -> DataFrame:
    group = F.lit("") if within is None else F.col(within).cast("string")
    return df.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & group.isNotNull()).select(group.alias("g"), F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias("b"))


def block_pairs(left: DataFrame, right: DataFrame, key: str, vector: str, count_left: int, count_right: int, within: str | None, limit: int) -> DataFrame:
    """The ``limit`` nearest rows (g, id_a, id_b, similarity) of each query in each block of the rows, by blocked matrix products.

    Every block of ``left`` meets every block of ``right`` of its group, once, in
    a task of its own; a block is dealt to as many tasks as the other side has
    blocks.
    """
    a = _blocks(left, key, vector, within, count_left).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(count_right - 1)))).select("g", F.concat_ws("-", "b", "o").alias("task"), F.lit(0).alias("side"), "id", "v")
    b = _blocks(right, key, vector, within, count_right).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(count_left - 1)))).select("g", F.concat_ws("-", "o", "b").alias("task"), F.lit(1).alias("side"), "id", "v")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if x.empty or y.empty:
            return pd.DataFrame({"g": pd.Series([], dtype=object), "id_a": pd.Series([], dtype="int64"), "id_b": pd.Series([], dtype="int64"), "similarity": pd.Series([], dtype="float64")})
        ids_x, ids_y = x["id"].to_numpy(), y["id"].to_numpy()
        right_unit = _unit(list(y["v"])).T
        out = []
        for at in range(0, len(x), 512):
            sims = _unit(list(x["v"].iloc[at : at + 512])) @ right_unit
            sims = np.where(ids_x[at : at + 512, None] != ids_y[None], sims, -np.inf)
            order = np.lexsort((np.broadcast_to(ids_y, sims.shape), -sims), axis=1)[:, :limit]
            i, j = np.repeat(np.arange(len(sims)), order.shape[1]), order.ravel()
            good = np.isfinite(sims[i, j])
            i, j = i[good], j[good]
            out.append(pd.DataFrame({"id_a": ids_x[at + i], "id_b": ids_y[j], "similarity": sims[i, j]}))
        found = pd.concat(out, ignore_index=True)
        found.insert(0, "g", pd.Series([str(pdf["g"].iloc[0])] * len(found), dtype=object))
        return found

    return a.unionByName(b).groupBy("g", "task").applyInPandas(meet, "g string, id_a long, id_b long, similarity double")


def _count(n: int) -> int:
    return max(1, -(-n // BLOCK))


def _group_pairs(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (id_a < id_b, similarity) of rows (g, id, v) of one group whose cosine is at least ``least``.

    A group is cut into as many blocks as its own size asks for, and each two
    blocks of it meet once, in one task; a task holds two blocks at most.
    """
    sizes = rows.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    blocked = rows.join(sizes, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    dealt = blocked.select("g", "id", "v", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")).select("g", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "v")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        ids, block = pdf["id"].to_numpy(), pdf["b"].to_numpy()
        unit = _unit(list(pdf["v"]))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = []
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            sims = unit[part] @ unit[right].T
            x, y = np.nonzero(sims >= least)
            keep = ids[part[x]] < ids[right[y]] if i == j else ids[part[x]] != ids[right[y]]
            a, b = ids[part[x[keep]]], ids[right[y[keep]]]
            out.append(pd.DataFrame({"id_a": np.minimum(a, b), "id_b": np.maximum(a, b), "similarity": sims[x[keep], y[keep]]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id_a": [], "id_b": [], "similarity": []})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            keys = pdf[["g", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(pdf) else []
            for k, at in enumerate(starts):
                part = pdf.iloc[at : starts[k + 1] if k + 1 < len(starts) else len(pdf)]
                if held and tuple(held[0][["g", "i", "j"]].iloc[0]) != tuple(part[["g", "i", "j"]].iloc[0]):
                    whole = pd.concat(held)
                    if len(whole) > 1:
                        yield products(whole)
                    held = []
                held.append(part)
        if held and len(whole := pd.concat(held)) > 1:
            yield products(whole)

    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInPandas(run, "id_a long, id_b long, similarity double")


def bands(least: float, recall: float, most_tables: int = 256) -> tuple[int, int]:
    """(bits, tables) of an index of random hyperplanes that finds a pair of cosine ``least`` with probability ``recall``, the most selective one within ``most_tables``."""
    same = 1 - np.arccos(np.clip(least, -1, 1)) / np.pi
    best = (1, 1)
    for bits in range(1, 63):
        tables = int(np.ceil(np.log(1 - recall) / np.log1p(-min(same**bits, 1 - 1e-12))))
        if tables > most_tables:
            break
        best = (bits, tables)
    return best


def similarity_edges(df: DataFrame, key: str, vector: str, least: float, within: str | None = None, recall: float | None = None, seed: int = 7) -> DataFrame:
    """Pairs (id_a < id_b, similarity) whose cosine is at least ``least``; with ``within`` only in one group.

    Without ``recall`` exactly: every two blocks of a group meet. With it by an
    index: the signs of seeded random projections, in several tables, put every
    row into one bucket a table; only rows of a bucket meet, their similarities
    are exact, and ``recall`` is the least share of the pairs that is found. The
    exchange then grows with the rows, not with their square; it pays from about
    ``least`` 0.6 on, below which buckets that find everything hold nearly all
    rows. Null vectors have no pairs, zero vectors none above 0.
    """
    group = F.lit("") if within is None else F.col(within).cast("string")
    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull() & group.isNotNull()).select(group.alias("g"), F.col(key).alias("id"), F.col(vector).alias("v"))
    if recall is None:
        return _group_pairs(rows, least)
    bits, tables = bands(least, recall)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.array([np.asarray(v, np.float64) for v in pdf["v"]])
            planes = np.random.default_rng(seed).normal(size=(x.shape[1], bits * tables))
            signs = (x @ planes > 0).reshape(len(x), tables, bits)
            codes = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)
            yield pd.DataFrame({"g": pdf["g"], "id": pdf["id"], "v": pdf["v"], "codes": list(codes)})

    coded = rows.mapInPandas(sign, "g string, id long, v array<double>, codes array<long>")
    each = coded.select("g", "id", "v", F.posexplode("codes").alias("t", "code")).select(F.concat_ws("|", "g", "t", "code").alias("g"), "id", "v")
    return _group_pairs(each, least).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, within: str | None = None) -> DataFrame:
    """The ``k`` nearest rows of each query (id_a, id_b, similarity, rank), never itself; ties by id. A stated query set meets all rows in blocks."""
    pairs = block_pairs(queries, rows, key, vector, _count(queries.count()), _count(rows.count()), within, k)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("similarity"), "id_b")))
    return ranked.where(F.col("rank") <= k).select("id_a", "id_b", "similarity", "rank")


def components(edges: DataFrame, nodes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component): connected components, named by their least id; nodes without edges are their own.

    Alternating large-star and small-star steps join each node to ever smaller
    ids. A round sends each edge a constant number of times, a hub's neighbours
    are aggregated before the exchange, and the lineage is cut in the shared
    folder. Rounds end when the edges' number and hashes stay; it fails rather
    than end early.
    """
    pairs = edges.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).where(F.col("u") != F.col("v"))
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    hashed = F.xxhash64("u", "v")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(hashed), F.sum(F.shiftright(hashed, 16))).first()
    before = mark(pairs)
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low2.select("u", F.col("m").alias("v")))
        nxt = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        pairs, now = nxt, mark(nxt)
        if now == before:
            named = nodes.select(F.col("id")).distinct().join(pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "id", "left")
            return named.select("id", F.coalesce("component", "id").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def centroid_clusters(df: DataFrame, group: str, key: str, vector: str, tau: float) -> DataFrame:
    """Greedy centroid clustering within groups (group, id, cluster): each vector joins the nearest centroid at ``tau`` or more, else starts one. Depends on the order of keys, so a group is one task's; one of more than ``MOST_IN_GROUP`` vectors fails instead of running out of memory (components have no such bound)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_IN_GROUP:
            raise ValueError(f"more than {MOST_IN_GROUP} vectors in group {pdf['g'].iloc[0]}")
        pdf = pdf.sort_values("id")
        unit = _unit(list(pdf["v"]))
        sums, norms = np.zeros_like(unit), np.zeros(len(unit))
        labels: list[int] = []
        made = 0
        for x in unit:
            sims = np.divide(sums[:made] @ x, norms[:made], out=np.zeros(made), where=norms[:made] > 0)
            at = int(sims.argmax()) if made else -1
            if at < 0 or sims[at] < tau:
                at, made = made, made + 1
            sums[at] += x
            norms[at] = np.linalg.norm(sums[at])
            labels.append(at)
        return pd.DataFrame({"g": pdf["g"], "id": pdf["id"], "cluster": labels})

    return df.select(F.col(group).cast("string").alias("g"), F.col(key).alias("id"), F.col(vector).alias("v")).groupBy("g").applyInPandas(one, "g string, id long, cluster int")
