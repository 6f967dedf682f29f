"""Filling containers of fixed capacity by minimum bin slack."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Every item is packed once for each kind, so kinds are few.
MOST_KINDS = 1000


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> tuple[int, dict[int, int]]:
    """The greatest total up to ``room`` that a multiset of lengths reaches, and how often each is used.

    Subset sums as bits of one integer; the multiplicity of a length is added in
    powers of two. It stops at the first length that completes ``room``.
    """
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for n in lengths:
        if n > room:
            continue
        left, k = min(counts[n], room // n), 1
        while left:
            take = min(k, left)
            new = (reach | (reach << (n * take))) & mask
            if new != reach:
                trail.append((n, take, reach))
                reach = new
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    at = total
    for n, take, before in reversed(trail):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + take
            at -= n * take
    return total, used


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> number, times) that use up a histogram of lengths of at most ``capacity``.

    Each bin takes the longest length left and then the fullest feasible
    combination of the others. As long as a combination can be taken again it is
    again a fullest one, so it is taken as often as the counts allow. Then one of
    its lengths has fewer left than a bin of it takes, which bounds the number of
    patterns by the lengths and their multiplicities, not by the items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        seed = lengths[0]
        left[seed] -= 1
        _, used = fullest(left, [n for n in lengths if left[n]], capacity - seed)
        left[seed] += 1
        pattern = dict(used)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((pattern, times))
    return out


def plan_rows(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The patterns as (length, first rank, ranks, per bin, first bin): items of a length, ranked from 0, fill bins in order."""
    out, used, first_bin = [], {}, 0
    for pattern, times in minimum_bin_slack(counts, capacity):
        for n, k in pattern.items():
            out.append((n, used.get(n, 0), k * times, k, first_bin))
            used[n] = used.get(n, 0) + k * times
        first_bin += times
    return out


def pack(items: DataFrame, capacities: DataFrame, item: str, size: str, kind: str, capacity: str, salts: int = 256) -> DataFrame:
    """Container of every piece: (container_kind, container_id, item_id, piece_no, start, length).

    An item longer than the capacity is cut into full pieces, which fill a
    container each, and a rest; no other item is cut. All pieces are packed by
    minimum bin slack over the histogram of *all* lengths, which has at most
    ``capacity`` entries for a kind whatever the number of items; each kind is
    planned in a task of its own, and nothing of it reaches the driver. Pieces of
    one length are interchangeable: each gets its rank among them, counted by
    (length, salt) first so that no length gathers in one task, and finds its
    container among the steps of the plan that its salt's ranks fall in, which
    come with the salt's offset in the same join.

    Items with a null, zero or negative size, and kinds with a null or
    non-positive capacity, are left out. Repeated item identifiers are packed
    each time, each in a place of its own. Ties follow a hash of the identifier,
    then the identifier and the piece.
    """
    named = capacities.where(F.col(capacity) > 0).select(F.col(kind).alias("container_kind"), F.col(capacity).cast("long").alias("capacity")).distinct().limit(MOST_KINDS + 1).collect()
    if len(named) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    kinds = F.array(*[F.struct(F.lit(r.container_kind).alias("container_kind"), F.lit(r.capacity).alias("capacity")) for r in named]) if named else F.array().cast("array<struct<container_kind:string,capacity:bigint>>")
    sized = items.where((F.col(size) > 0) & F.col(item).isNotNull()).select(F.col(item).alias("item_id"), F.col(size).cast("long").alias("size"))
    both = sized.select("item_id", "size", F.inline(kinds))
    last = F.floor((F.col("size") - 1) / F.col("capacity"))
    pieces = both.select("container_kind", "capacity", "item_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("p"))
    pieces = pieces.select("container_kind", "capacity", "item_id", "p", F.least("capacity", F.col("size") - F.col("p") * F.col("capacity")).alias("length"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("item_id", "p"), F.lit(salts)))
    counted = pieces.groupBy("container_kind", "capacity", "length", "salt").agg(F.count("*").alias("n"))
    offsets = counted.withColumn("before", F.sum("n").over(Window.partitionBy("container_kind", "length").orderBy("salt")) - F.col("n"))

    def plan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = plan_rows(dict(zip(pdf["length"].astype(int), pdf["n"].astype(int))), int(key[1]))
        out = pd.DataFrame(found, columns=["length", "first_rank", "ranks", "per_bin", "first_bin"])
        out.insert(0, "container_kind", key[0])
        return out

    histogram = counted.groupBy("container_kind", "capacity", "length").agg(F.sum("n").alias("n"))
    histogram = histogram.repartition(max(1, len(named)) * 4, "container_kind", "capacity")  # a stated number, which is not coalesced: kinds are planned side by side
    plans = histogram.groupBy("container_kind", "capacity").applyInPandas(plan, "container_kind string, length long, first_rank long, ranks long, per_bin long, first_bin long")
    by_length = plans.groupBy("container_kind", "length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "ranks", "per_bin", "first_bin"))).alias("plan"))
    own_steps = F.filter("plan", lambda s: (s["first_rank"] < F.col("before") + F.col("n")) & (s["first_rank"] + s["ranks"] > F.col("before")))
    offsets = offsets.join(by_length, ["container_kind", "length"]).select("container_kind", "length", "salt", "before", own_steps.alias("plan"))
    ranked = pieces.withColumn("k", F.row_number().over(Window.partitionBy("container_kind", "length", "salt").orderBy(F.xxhash64("item_id"), "item_id", "p")) - 1)
    placed = ranked.join(offsets, ["container_kind", "length", "salt"]).withColumn("rank", F.col("k") + F.col("before"))
    # the plan's steps are in order of rank: the wanted one is the last that begins at or before it
    placed = placed.withColumn("s", F.element_at(F.filter("plan", lambda s: s["first_rank"] <= F.col("rank")), -1))
    bin_no = F.col("s.first_bin") + F.floor((F.col("rank") - F.col("s.first_rank")) / F.col("s.per_bin"))
    return placed.select("container_kind", F.concat_ws("-", F.lit("bin"), bin_no.cast("string")).alias("container_id"), "item_id", (F.col("p") + 1).cast("int").alias("piece_no"), (F.col("p") * F.col("capacity")).alias("start"), "length")


def fill_report(packed: DataFrame, capacities: DataFrame, kind: str, capacity: str) -> DataFrame:
    """(container_kind, capacity, containers, items, used, fill) of each kind."""
    used = packed.groupBy("container_kind", "container_id").agg(F.sum("length").alias("used"), F.count("*").alias("items"))
    total = used.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("used"), F.max("used").alias("most"))
    kinds = capacities.select(F.col(kind).alias("container_kind"), F.col(capacity).cast("long").alias("capacity"))
    return kinds.join(total, "container_kind").withColumn("fill", F.col("used") / (F.col("containers") * F.col("capacity")))
