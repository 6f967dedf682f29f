"""Frequencies of distinct terms by compressed bitmaps of record identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Records of one container; a container's identifiers fit in 16 bits.
CONTAINER = 1 << 15
#: A container with more records than this is stored as a bitmap of ``CONTAINER`` bits, else as sorted 16-bit numbers.
DENSE = CONTAINER // 16


def encode(positions: np.ndarray) -> bytes:
    """A container's positions as bytes, in the shorter of the two forms; the first byte tells which."""
    positions = np.unique(np.asarray(positions, np.uint16))
    if len(positions) <= DENSE:
        return b"a" + positions.astype("<u2").tobytes()
    bits = np.zeros(CONTAINER, np.uint8)
    bits[positions] = 1
    return b"b" + np.packbits(bits).tobytes()


def decode(data: bytes) -> np.ndarray:
    """The sorted positions of an encoded container."""
    if data[:1] == b"a":
        return np.frombuffer(data, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1))).astype(np.uint16)


def union(containers: list[bytes]) -> bytes:
    """Union of encoded containers of the same identifiers."""
    if len(containers) == 1:
        return containers[0]
    bits = np.zeros(CONTAINER, bool)
    for c in containers:
        bits[decode(c)] = True
    return encode(np.flatnonzero(bits))


def cardinality(data: bytes) -> int:
    """Number of records of an encoded container."""
    return (len(data) - 1) // 2 if data[:1] == b"a" else int(np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).sum())


@F.pandas_udf(T.IntegerType())
def bitmap_cardinality(data: pd.Series) -> pd.Series:
    return data.map(cardinality).astype("int32")


def record_numbers(rows: DataFrame, record: str, buckets: int) -> DataFrame:
    """Dense identifiers (record, container, position) of the distinct non-null records.

    Records are dealt to ``buckets`` hash buckets and numbered within each;
    numbers beyond ``CONTAINER`` open further containers. No record, however
    frequent, weighs more than one row here.
    """
    distinct = rows.where(F.col(record).isNotNull()).select(F.col(record).alias("record")).distinct()
    bucket = distinct.withColumn("b", F.pmod(F.xxhash64("record"), F.lit(buckets)))
    numbered = bucket.withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy("record")) - 1)
    return numbered.select("record", (F.col("b") + F.floor(F.col("i") / CONTAINER) * buckets).cast("long").alias("container"), (F.col("i") % CONTAINER).cast("int").alias("position"))


_KEYS = ["field_name", "term", "container"]
_PARTS = "field_name string, term string, container long, occurrences long, bits binary"


def partial_bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Encoded containers and occurrence counters of the rows (field_name, term, container, position, n) of each batch; a null position only counts."""
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf.sort_values([*_KEYS, "position"], kind="stable")
        first = np.flatnonzero(np.r_[True, (pdf[_KEYS].iloc[1:].to_numpy() != pdf[_KEYS].iloc[:-1].to_numpy()).any(1)])
        ends = np.r_[first[1:], len(pdf)]
        positions = pdf["position"].to_numpy(float)
        out = pdf[_KEYS].iloc[first].copy()
        out["occurrences"] = np.add.reduceat(pdf["n"].to_numpy(np.int64), first)
        parts = (positions[i:j] for i, j in zip(first, ends))
        out["bits"] = [encode(x[~np.isnan(x)].astype(np.uint16)) for x in parts]
        yield out


def merge_bitmaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unions of the partial containers of each key and sums of their counters, of rows that come sorted by key; a key may go on in the next batch."""
    held: tuple | None = None
    done: list[tuple] = []
    for pdf in batches:
        for field, term, container, n, bits in pdf[[*_KEYS, "occurrences", "bits"]].itertuples(index=False):
            key = (field, term, container)
            if held is not None and held[0] == key:
                held[1].append(bits)
                held[2][0] += n
            else:
                if held is not None:
                    done.append((*held[0], held[2][0], union(held[1])))
                held = (key, [bits], [n])
        if len(done) >= 10_000:
            yield pd.DataFrame(done, columns=[*_KEYS, "occurrences", "bits"])
            done = []
    if held is not None:
        done.append((*held[0], held[2][0], union(held[1])))
    if done:
        yield pd.DataFrame(done, columns=[*_KEYS, "occurrences", "bits"])


def term_bitmaps(rows: DataFrame, record: str, terms: dict[str, Column], buckets: int = 512) -> DataFrame:
    """Vertical layout (field_name, term, container, occurrences, bits) of the terms of named columns.

    Rows are counted by (field, term, record) before any join, so that neither a
    frequent term nor a frequent record gathers in one task. With the records'
    numbers joined on, each map task builds the compressed containers of its rows
    with occurrence counters beside them; only these partial bitmaps are sent on,
    and merged by union where their key is sorted together. A container has at
    most ``CONTAINER`` records, so a frequent term is many keys. Null and empty
    terms do not count; occurrences in rows without a record count in container
    -1, whose bitmap is empty. Repeated rows count each time as occurrences and
    once as a record.
    """
    each = F.array(*[F.struct(F.lit(k).alias("field_name"), c.alias("term")) for k, c in terms.items()])
    pairs = rows.select(F.col(record).alias("record"), F.inline(each)).where(F.col("term") != "")
    pairs = pairs.groupBy("field_name", "term", "record").agg(F.count("*").alias("n"))
    numbered = pairs.join(record_numbers(rows, record, buckets), "record", "left")
    numbered = numbered.select("field_name", "term", F.coalesce("container", F.lit(-1).cast("long")).alias("container"), "position", "n")
    partial = numbered.mapInPandas(partial_bitmaps, _PARTS)
    return partial.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInPandas(merge_bitmaps, _PARTS)


def term_frequencies(bitmaps: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, records) of each term, from the occurrence counters and the cardinalities of the bitmaps."""
    sized = bitmaps.select("field_name", "term", "occurrences", bitmap_cardinality("bits").alias("size"))
    return sized.groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("size").cast("long").alias("records"))


def marked(frequencies: DataFrame, total: DataFrame, least: int, most_share: float) -> DataFrame:
    """Frequencies with ``mark``: ``rare`` below ``least`` records, ``common`` above ``most_share`` of all records (one row, column ``records_total``), else null. A term that is both is rare."""
    return frequencies.withColumn("mark", F.when(F.col("records") < least, "rare").when(F.col("records") > most_share * total.scalar(), "common"))


def normal_term(c: Column) -> Column:
    """Lower case with runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
