"""A schema that grows by recurrence: support, promotion, backfill and curves."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.ordered import numbered, prefix_sum


def support(df: DataFrame, keys: Sequence[str], case: str) -> DataFrame:
    """Distinct cases (support) of each key, always counted anew; null cases do not count."""
    return df.groupBy(*keys).agg(F.count_distinct(case).alias("support"))


def pooled_support(df: DataFrame, aliases: DataFrame, name: str, canonical: str, case: str) -> DataFrame:
    """Distinct cases of each canonical name over all its aliases; a name without alias stands for itself."""
    named = df.join(aliases.select(name, canonical), name, "left")
    return support(named.select(F.coalesce(canonical, name).alias(canonical), case), [canonical], case)


def promote(df: DataFrame, head: str, qualifier: str, case: str, heads_from: int, qualifiers_from: int, barred: Column | None = None) -> DataFrame:
    """Promoted concepts (kind, head, qualifier, support): heads by ``heads_from`` cases, and under promoted heads qualifiers by ``qualifiers_from``.

    ``barred`` says of a row whether its concept must not be promoted. Null and
    empty heads and qualifiers are no concepts.
    """
    rows = df.where((F.col(head) != "") & (F.lit(True) if barred is None else ~F.coalesce(barred, F.lit(False))))
    heads = support(rows, [head], case).where(F.col("support") >= heads_from)
    variants = support(rows.where(F.col(qualifier) != ""), [head, qualifier], case).where(F.col("support") >= qualifiers_from)
    variants = variants.join(heads.select(head), head, "left_semi")
    a = heads.select(F.lit("head").alias("kind"), F.col(head).alias("head"), F.lit(None).cast("string").alias("qualifier"), "support")
    return a.unionByName(variants.select(F.lit("variant").alias("kind"), F.col(head).alias("head"), F.col(qualifier).alias("qualifier"), "support"))


def backfill_worklist(cases: DataFrame, attempts: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """The next bounded batch: the oldest ``size`` cases without an attempt. The limit is the operator's feature."""
    return cases.join(attempts.select(key).distinct(), key, "left_anti").orderBy(*order).limit(size)


def backfill_batch(cases: DataFrame, attempts: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """The next bounded batch with ``more``, whether cases are left behind it; so a run can be broken off and go on."""
    ahead = backfill_worklist(cases, attempts, key, order, size + 1).withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # size + 1 rows
    return ahead.where(F.col("_n") <= size).withColumn("more", ahead.agg(F.count("*") > size).scalar()).drop("_n")


def backfill_marks(batch: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, marker) to append to the attempts after a batch: ``found`` for cases that ``found`` has, ``absent`` for the others, so that neither is tried again."""
    hit = found.select(key).distinct().withColumn("_f", F.lit(True))
    return batch.select(key).join(hit, key, "left").select(key, F.when(F.col("_f"), "found").otherwise("absent").alias("marker"))


def new_names_curve(df: DataFrame, name: str, by: str, ties: Sequence[str], width: int) -> DataFrame:
    """(bucket, new_names): names seen for the first time in each bucket of ``width`` rows in order; buckets without are 0."""
    ordered = numbered(df, [], by, ties, "_n").withColumn("bucket", F.floor((F.col("_n") - 1) / width))
    first = ordered.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("bucket").alias("bucket"))
    counts = first.groupBy("bucket").agg(F.count("*").alias("new_names"))
    return ordered.select("bucket").distinct().join(counts, "bucket", "left").select("bucket", F.coalesce("new_names", F.lit(0)).alias("new_names"))


def cumulative(curve: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """A curve with its running total, summed up in two levels: a curve has a row for every few rows of its table."""
    return prefix_sum(curve, [], by, [], F.col(value), out)


def hapax(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(names, once, fraction): share of the names that occur in one row."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("names"), F.count_if(F.col("n") == 1).alias("once")).withColumn("fraction", F.col("once") / F.col("names"))


def dedup_band(similarity: Column, merge: float = 0.85, admit: float = 0.70) -> Column:
    """merge, admit_new, or adjudicate between the two; without a neighbour the name is a seed."""
    return F.when(similarity.isNull(), "seed").when(similarity >= merge, "merge").when(similarity < admit, "admit_new").otherwise("adjudicate")


#: Most names of one head that a task works off; a larger head fails by name instead of running out of memory.
MOST_NAMES = 500_000


def canonicalise(names: DataFrame, head: str, name: str, vector: str, order: str, merge: float = 0.85) -> DataFrame:
    """Sequential canonicalisation within each head: (head, name, canonical, similarity, method).

    In order, each name joins the most similar canonical made so far if that is at
    least ``merge``, else it becomes one. The result depends on the order, so a
    head is worked off by one task; only its distinct names reach it (the first
    of each by order), and at most ``MOST_NAMES``: a larger head fails by name.
    Ties of similarity go to the canonical that came first.
    """
    import numpy as np

    from caseloom.operators.ordered import first_by

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order_key", "name"], kind="stable")
        width = len(pdf["vector"].iloc[0]) if len(pdf) else 0
        kept = np.zeros((len(pdf), width))
        labels: list[str] = []
        out = []
        for nm, v in zip(pdf["name"], pdf["vector"]):
            v = np.asarray(v, float)
            norm = np.linalg.norm(v)
            unit = v / norm if norm else v
            sims = kept[: len(labels)] @ unit
            best = int(sims.argmax()) if len(labels) else -1
            if best >= 0 and sims[best] >= merge:
                out.append((nm, labels[best], float(sims[best]), "merge"))
            else:
                out.append((nm, nm, float(sims[best]) if best >= 0 else 0.0, "admit_new" if best >= 0 else "seed"))
                kept[len(labels)] = unit
                labels.append(nm)
        result = pd.DataFrame(out, columns=["name", "canonical", "similarity", "method"])
        result.insert(0, "head", pdf["head"].iloc[0])
        return result

    rows = names.select(F.col(head).cast("string").alias("head"), F.col(name).cast("string").alias("name"), F.col(vector).alias("vector"), F.col(order).alias("order_key"))
    rows = first_by(rows.where(F.col("head").isNotNull() & F.col("vector").isNotNull()), ["head", "name"], ["order_key"], ["vector", "order_key"])
    sizes = rows.groupBy("head").agg(F.count("*").alias("_n"))
    fits = F.when(F.col("_n") > MOST_NAMES, F.raise_error(F.concat(F.lit("too many names under "), F.col("head")))).otherwise(F.lit(True))
    rows = rows.join(sizes.where(fits).drop("_n"), "head", "left_semi")
    return rows.groupBy("head").applyInPandas(one, "head string, name string, canonical string, similarity double, method string")


def backfill_fanout(attested: DataFrame, categories: DataFrame, heads: DataFrame, head: str, category: str, case: str) -> DataFrame:
    """(head, naive_calls, optimised_calls) of the promoted ``heads``: distinct cases in the categories of a head's attesting cases, and those of them that do not attest it.

    ``attested`` has (head, case) and ``categories`` (category, case); a case may
    have several categories, and a null one is a category of its own. Null cases
    do not count, nor do cases without a row in ``categories``.
    """
    pairs = categories.where(F.col(case).isNotNull()).select(F.col(category).alias("_c"), F.col(case).alias("_case")).distinct()
    numbers = heads.select(head).distinct().withColumn("_n", F.row_number().over(Window.orderBy(head)) - 1)  # the registry of promoted heads, not cases
    numbers = numbers.select(head, F.floor(F.col("_n") / 64).alias("_word"), (F.col("_n") % 64).alias("_bit"))
    own = attested.select(head, F.col(case).alias("_case")).distinct().join(numbers.select(head), head, "left_semi").join(pairs.select("_case"), "_case", "left_semi")
    scope = own.join(pairs, "_case").select(head, F.col("_c").alias("_s")).distinct().join(numbers, head)
    masks = scope.groupBy("_s", "_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))).alias("_m"))
    cases = pairs.join(masks, F.col("_s").eqNullSafe(F.col("_c"))).groupBy("_case", "_word").agg(F.bit_or("_m").alias("_m"))
    bits = F.array(*[F.sum(F.shiftrightunsigned("_m", i).bitwiseAND(F.lit(1).cast("long"))) for i in range(64)])
    naive = cases.groupBy("_word").agg(bits.alias("_all")).select("_word", F.posexplode("_all").alias("_bit", "naive_calls"))
    has = own.groupBy(head).agg(F.count("*").alias("_has"))
    return numbers.join(naive, ["_word", "_bit"]).join(has, head).select(head, "naive_calls", (F.col("naive_calls") - F.col("_has")).alias("optimised_calls"))
