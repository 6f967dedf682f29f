"""Mixing sources to target shares of the total size."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.plans.sizing import cut

#: Least number of blocks that each source is cut into; there are at least two a shard.
BLOCKS = 1024
SHARD_TOKENS = 50_000_000
LEAST_SHARDS = 16
#: Quotas (shards times sources) that the driver draws; beyond it ``shard_tokens`` has to be greater.
MOST_QUOTAS = 50_000_000


@dataclass(frozen=True)
class Target:
    """Target share and most repeats of a source, and its size."""

    share: float
    repeats: int
    tokens: int


def reachable_total(targets: dict[str, Target]) -> float:
    """The greatest total size at which every source that has rows reaches its share."""
    shares = {s: t.share for s, t in targets.items() if t.share > 0 and t.tokens > 0 and t.repeats > 0}
    if not shares:
        return 0.0
    whole = sum(shares.values())
    return min(targets[s].tokens * targets[s].repeats / (x / whole) for s, x in shares.items())


def needs(targets: dict[str, Target], total: float) -> dict[str, int]:
    """Size to take from each source for a total: its share of it, or all its repeats where that is less."""
    usable = {s: t for s, t in targets.items() if t.share > 0 and t.tokens > 0 and t.repeats > 0}
    whole = sum(t.share for t in usable.values())
    return {s: min(t.tokens * t.repeats, round(total * t.share / whole)) for s, t in usable.items()}


def split_quotas(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard (shards, sources), by a tree of multivariate hypergeometric splits.

    A node deals its blocks to its two halves: the left half gets its exact part
    of the number, drawn without replacement from the sources' counts.
    """
    out = np.zeros((shards, len(counts)), np.int64)
    stack = [(0, shards, counts.astype(np.int64))]
    while stack:
        a, b, left = stack.pop()
        if b - a == 1:
            out[a] = left
            continue
        m = (a + b) // 2
        n = int(left.sum()) * (m - a) // (b - a)
        drawn = rng.multivariate_hypergeometric(left, n, method="marginals") if left.sum() else left
        stack += [(a, m, drawn), (m, b, left - drawn)]
    return out


def slots(sizes: dict[int, int], wanted: int, seed: int) -> list[tuple[int, int, int]]:
    """What to take of a source as (block, repeat_no, part), in random order: ``part`` is the size to take of the block, or -1 for all of it.

    Whole passes over the blocks come first; the last, partial one takes blocks in
    permuted order, and of the block it ends in only what is missing.
    """
    rng = np.random.default_rng(seed)
    ids = np.array(sorted(b for b, n in sizes.items() if n > 0), np.int64)
    total, own, left, repeat = sum(n for n in sizes.values() if n > 0), [], wanted, 1
    while left >= total > 0:
        own += [(int(b), repeat, -1) for b in ids]
        left -= total
        repeat += 1
    for b in rng.permutation(ids):
        if left <= 0:
            break
        own.append((int(b), repeat, -1 if sizes[b] <= left else int(left)))
        left -= sizes[b]
    return [own[i] for i in rng.permutation(len(own))]


def mix(items: DataFrame, targets: DataFrame, item: str, size: str, source: str, share: str, repeats: str, seed: int = 42, total: float | None = None, blocks: int = BLOCKS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Selected rows (item_id, source, size, repeat_no, shard, position) in which each source has its share of the total size.

    ``total`` is the wanted size; by default the greatest at which every source
    with rows reaches its share within its repeats. A larger one is met as far as
    the repeats allow. An item is taken once in each repeat; shares are exact to
    within one item of each source.

    Items of a source are dealt to blocks by a seeded hash, so a source with a
    third of all rows is as many tasks as any other. The driver sees one row a
    source and draws how many blocks of each a shard gets, by the splitting tree;
    which blocks these are is planned a source a task, and the plan, which grows
    with blocks and repeats, is joined and not collected. Shards follow the total
    size, without bound. Within a shard rows are shuffled by another hash.

    Items with a null key or source, without size, or of a source without target
    are left out; so are targets that are null or not positive. Rows of equal
    keys and sizes count as copies; each is used by itself.
    """
    wanted_of = targets.where((F.col(share) > 0) & (F.col(repeats) > 0) & F.col(source).isNotNull())
    wanted_of = wanted_of.groupBy(F.col(source).alias("source")).agg(F.sum(share).alias("share"), F.max(repeats).alias("repeats"))
    named = items.where((F.col(size) > 0) & F.col(item).isNotNull()).select(F.col(item).alias("item_id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    named = cut(named.join(wanted_of.select("source"), "source", "left_semi").withColumn("h", F.xxhash64(F.lit(seed), "source", "item_id")))
    known = wanted_of.join(named.groupBy("source").agg(F.sum("size").alias("n")), "source", "left").collect()  # one row a target
    goals = {r.source: Target(r.share, int(r.repeats), int(r.n or 0)) for r in known}
    size_of = needs(goals, reachable_total(goals) if total is None else total)
    shards = max(LEAST_SHARDS, -(-sum(size_of.values()) // shard_tokens))
    blocks = max(blocks, 2 * shards)
    if shards * max(1, len(goals)) > MOST_QUOTAS:
        raise ValueError(f"{shards} shards of {len(goals)} sources: shards must be larger than {shard_tokens}")
    named = named.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    sizes = cut(named.groupBy("source", "block").agg(F.sum("size").alias("n")))

    def chosen(key: tuple, pdf: pd.DataFrame) -> list[tuple[int, int, int]]:
        own_seed = int.from_bytes(hashlib.blake2b(f"{seed}|{key[0]}".encode(), digest_size=8).digest())
        return slots(dict(zip(pdf["block"].astype(int), pdf["n"].astype(int))), size_of.get(key[0], 0), own_seed)

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"source": [key[0]], "slots": [len(chosen(key, pdf))]})

    found = {r.source: r.slots for r in sizes.groupBy("source").applyInPandas(count, "source string, slots long").collect()}  # one row a source
    order = sorted(found)
    quotas = split_quotas(np.array([found[s] for s in order], np.int64), shards, np.random.default_rng(seed))
    ends = {s: np.cumsum(quotas[:, k]) for k, s in enumerate(order)}

    def deal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(chosen(key, pdf), columns=["block", "repeat_no", "part"])
        out.insert(0, "source", key[0])
        out["shard"] = np.searchsorted(ends[key[0]], np.arange(len(out)), side="right")
        return out

    plan = cut(sizes.groupBy("source").applyInPandas(deal, "source string, block int, repeat_no int, part long, shard int"))
    whole = named.join(plan.where("part < 0").drop("part"), ["source", "block"])
    cut_off = named.join(plan.where("part >= 0"), ["source", "block"])
    upto = F.sum("size").over(Window.partitionBy("source", "block").orderBy("h", "item_id").rowsBetween(Window.unboundedPreceding, 0))
    cut_off = cut_off.withColumn("_upto", upto).where(F.col("_upto") - F.col("size") / 2 <= F.col("part")).drop("_upto", "part")
    rows = whole.unionByName(cut_off)
    within = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "source", "item_id", "repeat_no"), "source", "item_id", "repeat_no")
    return rows.select("item_id", "source", "size", "repeat_no", "shard", F.row_number().over(within).alias("position"))


def share_report(mixed: DataFrame, targets: DataFrame, source: str, share: str, repeats: str) -> DataFrame:
    """(source, target_share, max_repeats, tokens, share, most_repeats, items) of every target; a source without rows has none."""
    used = mixed.groupBy("source").agg(F.sum("size").alias("tokens"), F.max("repeat_no").alias("most_repeats"), F.count("*").alias("items"))
    total = used.agg(F.sum("tokens").alias("all_tokens"))
    goals = targets.select(F.col(source).alias("source"), F.col(share).alias("target_share"), F.col(repeats).alias("max_repeats"))
    out = goals.join(used, "source", "left").withColumn("all_tokens", total.scalar())
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("source", "target_share", "max_repeats", zero("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), zero("items"))
