"""Language runs of messages and transcripts as DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm import languages
from caseloom.plans.sizing import cores, spread

#: Signs of a wrongly decoded text; such rows make no profile.
_GARBLED = r"[\u0080-\u009f�]|[ÃÂØÙÚÛ][^\sA-Za-z]|â€|&[A-Za-z]+;|à[¤¥]"


def fit_profiles(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = languages.DOCUMENTS_PER_LANGUAGE, size: int = languages.PROFILE_SIZE) -> languages.Profiles:
    """Profiles from ``per_language`` labelled rows of each language (the documented bound of the sample), picked by a hash of their key.

    Rows with a null, empty or garbled text or an unknown label are left out; a
    language without rows gets no profile of its own script. N-grams are counted
    in the cluster; the driver gets ``size`` rows a language.
    """
    rows = documents.where(F.col(lang).isin(*languages.LANGUAGES) & (F.length(text) > 0) & ~F.col(text).rlike(_GARBLED))
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h"))
    picked = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= per_language)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang_, part in pdf.groupby("lang"):
                grams = languages.profile_counts(lang_, list(part["text"]))
                if grams:
                    yield pd.DataFrame({"lang": lang_, "gram": list(grams), "n": list(grams.values())})

    grams = picked.select("lang", "text").repartition(cores(documents, 2)).mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    counts: dict[str, Counter] = {}
    for r in top.select("lang", "gram", "n").collect():  # at most size rows for each of a fixed set of languages
        counts.setdefault(r.lang, Counter())[r.gram] = r.n
    return languages.Profiles.build(counts, size)


def text_runs(rows: DataFrame, profiles: languages.Profiles, key: str, text: str) -> DataFrame:
    """Runs of consecutive sentences in one language: (row_id, runs), where ``runs`` has (run_no, lang, confidence, letters) numbered from 1.

    A text that is null, empty or without words gives no row. Whole texts are
    read. Repeated rows give repeated rows; other columns are ignored. Rows are
    independent; they are only dealt out over the cores.
    """
    shared = rows.sparkSession.sparkContext.broadcast(profiles)  # bounded by size and the fixed set of languages

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in batches:
            known: dict[str, list[dict]] = {}
            ids, out = [], []
            for i, t in zip(pdf["row_id"], pdf["text"]):
                found = known.get(t)
                if found is None:
                    found = known[t] = [{"run_no": k, "lang": r[0], "confidence": r[1], "letters": r[2]} for k, r in enumerate(languages.runs(p, t), 1)]
                if found:
                    ids.append(i)
                    out.append(found)
            if ids:
                yield pd.DataFrame({"row_id": ids, "runs": out})

    named = rows.select(F.col(key).cast("long").alias("row_id"), F.col(text).alias("text")).where(F.col("row_id").isNotNull() & (F.length("text") > 0))
    return spread(named).mapInPandas(run, "row_id long, runs array<struct<run_no:long,lang:string,confidence:double,letters:long>>")


def segment_languages(rows: DataFrame, profiles: languages.Profiles, key: str, segments: str, label: str) -> DataFrame:
    """Languages of the segments of each row: (row_id, lang, named, segments).

    ``lang`` is the language of most characters (of equals the one that comes
    first), ``named`` the one that the label names, or null; ``segments`` has
    (segment_no, lang, confidence, n_chars) by position from 1. A segment without
    words takes the language of the segments around it; a row none of whose
    segments has words gives none.
    """
    shared = rows.sparkSession.sparkContext.broadcast(profiles)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in batches:
            out = []
            for i, name, texts in zip(pdf["row_id"], pdf["label"], pdf["texts"]):
                texts = [t or "" for t in texts]
                found = languages.path(p, [p.distances(t) for t in texts])
                last = next((f for f in found if f), None)
                if last is None:
                    continue
                total: Counter = Counter()
                parts = []
                for k, (t, f) in enumerate(zip(texts, found), 1):
                    last = f or last
                    total[last[0]] += len(t)
                    parts.append({"segment_no": k, "lang": last[0], "confidence": last[1] if f else 0.0, "n_chars": len(t)})
                out.append((i, total.most_common(1)[0][0], languages.named_language(name), parts))
            if out:
                yield pd.DataFrame(out, columns=["row_id", "lang", "named", "segments"])

    named = rows.select(F.col(key).cast("long").alias("row_id"), F.col(label).alias("label"), F.transform(segments, lambda s: s["text"]).alias("texts")).where(F.col("row_id").isNotNull() & (F.size("texts") > 0))
    return spread(named).mapInPandas(each, "row_id long, lang string, named string, segments array<struct<segment_no:long,lang:string,confidence:double,n_chars:long>>")
