"""Operators on ordered rows that hold when one key has a large part of all rows.

A plain window over a key sorts all rows of the key in one task. Here rows are
first dealt to buckets that follow the order, windows run within (key, bucket),
and only one row for each key and bucket goes through a second window over the
key; its result is joined back. Buckets are cut at quantiles of the ordering
column, so neither a far-off moment nor a burst fills one, and their number
follows the number of rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about; and quantiles that are looked up for each row. More buckets than these cut each interval between two quantiles further.
BUCKET_ROWS, QUANTILES = 100_000, 256
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "timestamp", "date")


def as_number(c: Column, kind: str) -> Column:
    """An ordering column as a number: microseconds of moments, days of dates, else the value."""
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_date(c) if kind == "date" else c


def _place(cuts: list[float], value: Column) -> Column:
    """How many of the ordered cuts are at or below a value."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= value)) if cuts else F.lit(0)


def order_bucket(df: DataFrame, by: str, ties: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS) -> Column:
    """Number of the bucket of ``by`` (a number or moment), ascending with it; nulls come first.

    Costs one pass for the number of rows and the quantiles. A value that several
    quantiles share, and null, has buckets of its own, which follow the first of
    ``ties`` where that is a number.
    """
    kinds = dict(df.dtypes)
    value = as_number(F.col(by), kinds[by]).cast("double")
    tie = as_number(F.col(ties[0]), kinds[ties[0]]).cast("double") if ties and kinds[ties[0]].startswith(_NUMBERS) else F.lit(0.0)
    steps = [i / QUANTILES for i in range(QUANTILES)]
    n, cuts, tie_cuts = df.agg(F.count("*"), F.percentile_approx(value, steps, 20_000), F.percentile_approx(tie, steps, 2_000)).first()
    if not n or not cuts:
        cuts = []
    times = Counter(cuts)
    wanted = max(1, -(-n // bucket_rows))
    every = max(1, QUANTILES // wanted)
    kept = sorted({c for i, c in enumerate(cuts) if i % every == 0})
    heavy = [c for c, k in times.items() if k > max(2, every)]
    kept = sorted(set(kept) | set(heavy))
    parts = sorted(set(tie_cuts or []))[:: max(1, len(set(tie_cuts or [])) // max(1, min(wanted, 64)))]
    finer = max(1, -(-wanted // QUANTILES))
    place = _place(kept, value)
    if finer > 1:
        edges = F.array(*[F.lit(float(c)) for c in [*kept, kept[-1] + 1]])
        low, high = F.element_at(edges, F.greatest(place, F.lit(1))), F.element_at(edges, F.least(place + 1, F.lit(len(kept) + 1)))
        fine = F.greatest(F.lit(0), F.least(F.lit(finer - 1), F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * finer)))
    else:
        fine = F.lit(0)
    own = value.isNull() | (value.isin(*heavy) if heavy else F.lit(False))
    inner = F.when(own, _place(parts, tie)).otherwise(len(parts) + 1 + F.coalesce(fine, F.lit(0)))
    return (F.when(value.isNull(), -1).otherwise(place).cast("long") * (len(parts) + 2 + finer) + inner).cast("long")


def numbered(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str], out: str = "rn", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the position from 1 of each row within its key, in order of ``by`` and then ``ties``.

    Nulls of ``by`` come first. Keys may be empty (one numbering of all rows);
    null keys form a group. ``ties`` should be unique, else equal rows are
    numbered in any order.
    """
    return prefix_sum(df, keys, by, ties, F.lit(1).cast("long"), out, bucket_rows)


def _joined(base: DataFrame, parts: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Rows with what was found out about their (key, bucket); null keys meet."""
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), *extra)
    match = F.col("_b") == F.col("_kb")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return base.join(parts, match, "left")


def _running(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str], value: Column, out: str, fold, merge, last: int, bucket_rows: int) -> DataFrame:  # noqa: ANN001
    """A running fold in two levels: within (key, bucket), and over the totals of the buckets before."""
    kept = df.columns
    base = df.withColumn("_b", order_bucket(df, by, ties, bucket_rows)).withColumn("_v", value)
    within = Window.partitionBy(*keys, "_b").orderBy(F.col(by).asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, last)
    base = base.withColumn("_s", fold("_v").over(within))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy(*keys, "_b").agg(fold("_v").alias("_t")).withColumn("_o", fold("_t").over(before))
    return _joined(base, totals, keys, F.col("_o")).select(*kept, merge(F.col("_s"), F.col("_o")).alias(out))


def prefix_sum(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str], value: Column, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the running sum of ``value`` up to and with each row, in order of ``by`` and then ``ties`` within its key."""
    return _running(df, keys, by, ties, value, out, F.sum, lambda s, o: s + F.coalesce(o, F.lit(0)), 0, bucket_rows)


def running_max(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str], value: Column, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the greatest ``value`` of the rows *before* each row, in order of ``by`` and then ``ties`` within its key; null for the first."""
    return _running(df, keys, by, ties, value, out, F.max, lambda s, o: F.greatest(s, o), -1, bucket_rows)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keys, n, names of ``ranks``): the values of each key at ranks from 0, given as columns of ``n``, its number of non-null values.

    Values are counted first and their counts summed up in two levels, so no key
    is sorted in one task whatever its share of the rows.
    """
    levels = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = prefix_sum(levels, keys, value, [], F.col("_n"), "_upto", bucket_rows)
    total = levels.groupBy(*keys).agg(F.sum("_n").alias("n"))
    x = upto.join(total, list(keys))
    return x.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("_upto") > at, F.col(value))).alias(name) for name, at in ranks.items()])


def gap_sessions(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], gap_seconds: int, out: str = "session_no", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the number from 1 of each row's session: a new one begins where more than ``gap_seconds`` passed since the key's previous row.

    Exactly the gap still belongs together. Rows with a null moment are left out;
    null keys form a group.
    """
    kept = df.columns
    base = df.where(F.col(ts).isNotNull())
    base = base.withColumn("_b", order_bucket(base, ts, ties, bucket_rows)).withColumn("_u", as_number(F.col(ts), dict(df.dtypes)[ts]))
    limit = gap_seconds * 1_000_000
    within = Window.partitionBy(*keys, "_b").orderBy("_u", *ties)
    base = base.withColumn("_new", F.coalesce((F.col("_u") - F.lag("_u").over(within) > limit).cast("long"), F.lit(0)))
    base = base.withColumn("_n", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = base.groupBy(*keys, "_b").agg(F.min("_u").alias("_first"), F.max("_u").alias("_last"), F.sum("_new").alias("_breaks"))
    over = Window.partitionBy(*keys).orderBy("_b")
    parts = parts.withColumn("_open", F.coalesce((F.col("_first") - F.lag("_last").over(over) > limit).cast("long"), F.lit(1)))
    parts = parts.withColumn("_o", F.sum(F.col("_open") + F.col("_breaks")).over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_breaks"))
    return _joined(base, parts, keys, F.col("_o")).select(*kept, (F.col("_n") + F.col("_o")).alias(out))


def with_previous(df: DataFrame, keys: Sequence[str], by: str, ties: Sequence[str], values: Sequence[str], out: str = "previous", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with a struct of ``values`` of the key's previous row in order of ``by`` and then ``ties``; null for the first row of a key.

    Within a bucket the previous row is a lag; the first row of a bucket takes
    the last row of the key's bucket before. Nulls of ``by`` come first; null
    keys form a group.
    """
    kept = df.columns
    base = df.withColumn("_b", order_bucket(df, by, ties, bucket_rows)).withColumn("_s", F.struct(*values))
    within = Window.partitionBy(*keys, "_b").orderBy(F.col(by).asc_nulls_first(), *ties)
    base = base.withColumn("_p", F.lag("_s").over(within))
    lasts = base.groupBy(*keys, "_b").agg(F.max_by("_s", F.struct(by, *ties)).alias("_l"))
    lasts = lasts.withColumn("_o", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_b")))
    return _joined(base, lasts, keys, F.col("_o")).select(*kept, F.coalesce("_p", "_o").alias(out))


#: Types of fixed width, and those whose order is that of a whole number.
_FIXED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "timestamp", "date")
_WHOLE = ("tinyint", "smallint", "int", "bigint", "timestamp", "date")


def _fold_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], pick) -> DataFrame:  # noqa: ANN001
    """One row a key by ``pick`` (max_by or min_by). Where order and values have a fixed width each value is folded by itself in a hash aggregate; else all of them as a struct, for which rows are sorted."""
    kinds = dict(df.dtypes)
    if len(order) == 1 and kinds[order[0]].startswith(_WHOLE) and all(kinds[v].startswith(_FIXED) for v in values):
        least = F.lit(-(1 << 63)).cast("long")
        at = F.coalesce(as_number(F.col(order[0]), kinds[order[0]]).cast("long"), least)
        return df.groupBy(*keys).agg(*[pick(F.col(v), at).alias(v) for v in values])
    return df.groupBy(*keys).agg(pick(F.struct(*values), F.struct(*order)).alias("_one")).select(*keys, "_one.*")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the row of each key that is greatest by ``order``; an aggregate, so each map task sends one row a key. Null order values count as least; a single order column should be unique within a key."""
    return _fold_by(df, keys, order, values, F.max_by)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the row of each key that is least by ``order``; nulls count as least."""
    return _fold_by(df, keys, order, values, F.min_by)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank; map tasks keep ``k`` rows a key before the exchange."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(out) <= k)
