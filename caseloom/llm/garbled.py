"""Garbled texts as DataFrames: fitting the model and repairing rows."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm import encodings
from caseloom.plans.sizing import cores, cut, spread

#: Signs of a wrong decoding; a row that has one is no clean record.
SIGNS = r"[\u0080-\u009f�─-▟]|[ÃÂØÙÚÛÐÑ][^\sA-Za-z]|â[€\u0080-ÿ‚-™]|&[A-Za-z]+;|à[¤¥]|Γ|√|вЂ|в‚|[ШЩ][Ѐ-ӿ„‡†]{1}|‚Ä|ÔÇ|[ŘŮ]"
#: What parts the words that are counted; the units that are judged lie within them.
BLANKS = "[ \n\t]+"
JUDGED = r"[^\u0000-\u007f]|&[A-Za-z#]"


def fit_model(rows: DataFrame, text: str = "text", stratum: Column | None = None) -> encodings.NgramModel:
    """Character n-gram model of clean records.

    All rows without signs of a wrong decoding train it, and all of them validate
    the margin: texts are halved by a hash, so that repeated ones stay together,
    and a model of each half judges the other one's words, rare and common ones
    alike, which may not pass the margin. Texts that the model finds garbled,
    though they have no sign, would teach it to like them; they are taken out of
    the counts, and model and margin are made again. How rare an n-gram is shows
    by ``stratum``, such as the language, so that a small one is not drowned.
    Null and empty texts are left out; where a half has no text, the margin is
    the least one and nothing is taken out. Without rows the model knows nothing
    and repairs only what is valid UTF-8.
    """
    h = F.xxhash64(text)
    part = F.coalesce(stratum.cast("string"), F.lit("")) if stratum is not None else F.lit("")
    clean = rows.where((F.length(text) > 0) & ~F.col(text).rlike(SIGNS)).select(F.col(text).alias("text"), h.alias("h"), F.pmod(h, F.lit(2)).cast("int").alias("half"), part.alias("part"))
    words = cut(_words(spread(clean, 1)))
    first, gains = _fit(words)
    if gains is None:
        return first
    gone = cut(_words(clean.join(cut(_garbled(clean, gains.where("own > 0"), first.margin)), "h", "left_semi")))
    if gone.isEmpty():
        return first
    less = gone.withColumns({c: -F.col(c) for c in ("n", "in_rows")})
    return _fit(cut(_summed(words.unionByName(less)).where("n > 0")), own=False)[0]


def _words(clean: DataFrame) -> DataFrame:
    """(word, half, part, n, in_rows): occurrences of each word by half and stratum; for words that can be garbled ``in_rows`` is the number of rows they occur in, for others 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (half, part), texts in pdf.groupby(["half", "part"])["text"]:
                n: Counter = Counter()
                inside: Counter = Counter()
                for t in texts:
                    found = t.replace("\n", " ").replace("\t", " ").split(" ")
                    n.update(found)
                    inside.update(w for w in set(found) if not w.isascii() or "&" in w)
                n.pop("", None)
                yield pd.DataFrame({"word": list(n), "half": half, "part": part, "n": list(n.values()), "in_rows": [inside[w] for w in n]})

    return _summed(clean.select("text", "half", "part").mapInPandas(count, "word string, half int, part string, n long, in_rows long"))


def _summed(words: DataFrame) -> DataFrame:
    return words.groupBy("word", "half", "part").agg(F.sum("n").alias("n"), F.sum("in_rows").alias("in_rows"))


def _fit(words: DataFrame, own: bool = True) -> tuple[encodings.NgramModel, DataFrame | None]:
    """Model of all words with its margin, and the judged words, see :func:`_gains`, or None where a half is empty."""
    *halves, model = _models(words)
    if not all(m.total for m in halves):
        return model, None
    gains = _gains(words, [*halves, model] if own else halves)
    model.margin = _margin(gains, model.margin)
    return model, gains


def _models(words: DataFrame) -> list[encodings.NgramModel]:
    """Models of the first half, of the second one, and of both."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: defaultdict = defaultdict(Counter)
        for pdf in batches:
            for at, some in pdf.groupby(["half", "part"]):
                encodings.count_grams(total[at], zip(some["word"], some["n"].tolist()))
        for (half, part), n in total.items():
            yield pd.DataFrame({"gram": list(n), "half": half, "part": part, "n": list(n.values())})

    grams = words.select("word", "half", "part", "n").repartition(cores(words, 2)).mapInPandas(count, "gram string, half int, part string, n long")
    of = [F.sum(F.when(F.col("half") == half, F.col("n")).otherwise(0)).alias(f"n{half}") for half in (0, 1)]
    counted = cut(grams.groupBy("gram", "part").agg(*of).withColumn("n2", F.col("n0") + F.col("n1")))
    totals = counted.where(F.length("gram") == 1).groupBy("part").agg(*(F.sum(f"n{i}").alias(f"t{i}") for i in range(3)))
    rates = [F.coalesce(F.sum(F.try_divide(f"n{i}", f"t{i}")), F.lit(0.0)).alias(f"r{i}") for i in range(3)]
    known = counted.join(totals, "part").groupBy("gram").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(3)), *rates)
    plain = (F.length("gram") == 1) | (F.octet_length("gram") == F.length("gram"))
    known = known.where(plain | (F.col("n2") >= encodings.LEAST) & (F.greatest("r0", "r1", "r2") >= encodings.LEAST_RATE))
    rows = known.withColumn("plain", plain).collect()  # their number follows the alphabets in use, not the rows
    return [encodings.NgramModel.build(Counter({r.gram: n for r in rows if (n := r[f"n{i}"]) and (r.plain or r[f"r{i}"] >= encodings.LEAST_RATE)})) for i in range(3)]


def _gains(words: DataFrame, models: list[encodings.NgramModel]) -> DataFrame:
    """(word, half, unit, gain, own, in_rows) of every unit that can be garbled: its gain by the model of the half that its row is not in, and by that of both, if given."""
    shared = words.sparkSession.sparkContext.broadcast(models)  # n-grams, see _models

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = shared.value[2:]
        for pdf in batches:
            out = []
            for w, half, n in zip(pdf["word"], pdf["half"], pdf["in_rows"]):
                out += [(w, half, u, shared.value[1 - half].gain(u)[0], both[0].repair(u)[2] if both else 0.0, n) for u in set(encodings.WORD.findall(w))]
            if out:
                yield pd.DataFrame(out, columns=["word", "half", "unit", "gain", "own", "in_rows"])

    held = words.where("in_rows > 0").groupBy("word", "half").agg(F.sum("in_rows").alias("in_rows"))
    # words differ much in cost; one that both halves have is judged by the model of both once
    return cut(held.repartition(cores(words, 4), "word").mapInPandas(judge, "word string, half int, unit string, gain double, own double, in_rows long"))


def _margin(gains: DataFrame, least: float) -> float:
    """The margin that the judged words do not pass; by gain, the few that gain anything come to the driver."""
    total = gains.agg(F.sum("in_rows")).first()[0] or 0
    found = gains.where("gain > 0").groupBy("gain").agg(F.sum("in_rows").alias("n")).collect()
    return encodings.margin_of([(r.gain, r.n) for r in found], total, least)


def _garbled(clean: DataFrame, found: DataFrame, margin: float) -> DataFrame:
    """Hashes ``h`` of the texts whose units together gain more than the margin, as :func:`encodings.repair_text` has it."""
    words = clean.where(F.col("text").rlike(JUDGED)).select("h", "half", F.explode(F.split("text", BLANKS)).alias("word"))
    words = words.where((F.octet_length("word") > F.length("word")) | F.col("word").contains("&"))
    units = words.join(found.select("word", "half", "unit", F.col("own").alias("gain")), ["word", "half"]).groupBy("h", "unit").agg(F.max("gain").alias("gain"))
    return units.groupBy("h").agg(F.sum("gain").alias("gain")).where(F.col("gain") > margin).select("h")


def repaired(rows: DataFrame, model: encodings.NgramModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (row_id, state, restored) for each row whose text is garbled.

    ``state`` is ``restored`` or, where characters were lost, ``lost``; then
    ``restored`` holds what can be had. Whole texts are read. Null, empty and
    ASCII texts are clean and give no row; repeated rows are judged by
    themselves; other columns are ignored. Rows without a character beyond ASCII
    and without an entity are filtered in the JVM.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # n-grams, see _models

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = []
            for i, t in zip(pdf["row_id"], pdf["text"]):
                state, fixed = encodings.repair_text(m, t)
                if state != "clean":
                    out.append((i, state, fixed))
            if out:
                yield pd.DataFrame(out, columns=["row_id", "state", "restored"])

    named = rows.select(F.col(key).cast("long").alias("row_id"), F.col(text).alias("text")).where(F.col("text").rlike(JUDGED))
    return spread(named).mapInPandas(run, "row_id long, state string, restored string")
