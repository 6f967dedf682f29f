"""Wrong decodings made on purpose, undone; clean texts left alone."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caseloom.llm import encodings as E
from caseloom.llm.garbled import SIGNS, fit_model, repaired
from caseloom.sources.tables import table

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def model(spark):
    return fit_model(table(spark, FOLDER, "documents"), stratum=F.col("lang"))


@pytest.fixture(scope="module")
def clean(spark):
    rows = table(spark, FOLDER, "documents").where(~F.col("text").rlike(SIGNS)).orderBy(F.xxhash64(F.col("doc_id") + 7)).limit(150)
    return [r.text for r in rows.collect() if not r.text.isascii()]


def wrong(text, write, read):
    raw = text.encode(write, "ignore")
    return "".join(E._TABLES[read][b] for b in raw)


def test_clean_texts_stay(model, clean):
    assert [t for t in clean if E.repair_text(model, t)[0] != "clean"] == []


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp1256"])
def test_round_trip(model, clean, read):
    done = [E.repair_text(model, wrong(t, "utf-8", read)) for t in clean]
    assert sum(s != "clean" for s, _ in done) >= 0.99 * len(clean)
    assert sum(x == t for (_, x), t in zip(done, clean)) >= 0.9 * len(clean)


def test_twice_and_in_places(model, clean):
    twice = [E.repair_text(model, wrong(wrong(t, "utf-8", "cp1252"), "utf-8", "cp1252")) for t in clean]
    assert sum(x == t for (_, x), t in zip(twice, clean)) >= 0.9 * len(clean)
    for t in clean[:40]:
        lines = t.split("\n")
        k = next(i for i, x in enumerate(lines) if not x.isascii())
        part = "\n".join([*lines[:k], wrong(lines[k], "utf-8", "cp1252"), *lines[k + 1 :]])
        assert E.repair_text(model, part) == ("restored", t)


def test_a_mix_up_of_single_bytes_behind_utf8(model, clean):
    """Written in cp1252, read as mac_roman, saved as UTF-8 and read as cp1252: the mix-up is the second step back."""
    done = total = 0
    for t in clean:
        try:
            garbled = wrong(wrong(t, "cp1252", "mac_roman").encode("utf-8").decode("utf-8"), "utf-8", "cp1252") if t.encode("cp1252") else t
        except UnicodeEncodeError:
            continue
        total += 1
        done += E.repair_text(model, garbled)[1] == t
    assert total and done >= 0.8 * total, (done, total)


def test_lost_characters(model):
    assert E.repair_text(model, "The caf� was closed")[0] == "lost"
    assert E.repair_text(model, "") == ("clean", "") and E.repair_text(model, "plain")[0] == "clean"


def test_operator_edges(spark, model):
    rows = [(1, "Weâ€™d paid Â£20 at the cafÃ©"), (1, "Weâ€™d paid Â£20 at the cafÃ©"), (2, "We’d paid £20 at the café"), (3, None), (4, ""), (5, "caf�"), (6, "It’s fine. " * 20_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, state string")
    assert sorted((r.row_id, r.state, r.restored) for r in repaired(df, model).collect()) == [(1, "restored", "We’d paid £20 at the café")] * 2 + [(5, "lost", "caf�")]
    assert repaired(df.limit(0), model).count() == 0
    none = fit_model(df.limit(0))
    assert repaired(df, none).where("row_id = 2").count() == 0


def test_every_row_counts(spark):
    texts = [f"Order {i} came late to the café\tin Nº{i % 7}, she said\n" + "with jalapeño" * (i % 400 == 0) for i in range(1600)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1600, "Weâ€™d paid", "en"), (1601, None, "en"), (1602, "", None)]
    fitted = fit_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), stratum=F.col("lang"))
    counts = Counter()
    E.count_grams(counts, [(w, 1) for t in texts for w in t.split()])
    whole = E.NgramModel.build(counts)
    assert (fitted.total, fitted.one, fitted.two, fitted.three) == (whole.total, whole.one, whole.two, whole.three)
    assert E.repair_text(fitted, "with jalapeño at the café") == ("clean", "with jalapeño at the café")
