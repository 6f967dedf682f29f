"""Languages of labelled texts that made no profile, and of mixed ones."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from caseloom.llm import languages as L
from caseloom.llm.language_runs import fit_profiles, segment_languages, text_runs
from caseloom.sources.tables import table

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def profiles(spark):
    return fit_profiles(table(spark, FOLDER, "documents"), per_language=40)


def test_held_out_documents(spark, profiles):
    """Rows beyond the sample: at least 0.98 right by whole text."""
    from caseloom.llm.language_runs import _GARBLED

    rows = table(spark, FOLDER, "documents").where(~F.col("text").rlike(_GARBLED) & (F.length("text") > 60)).select("lang", "text").collect()
    right = 0
    for r in rows:
        d, _ = profiles.distances(r.text)
        right += profiles.names[int(d.argmin())] == r.lang
    assert right / len(rows) >= 0.98, right / len(rows)


def test_runs_of_mixed_messages(spark, profiles):
    rows = [
        (1, "The driver never came and nobody called me back. Nadie me explicó el cargo en la factura. Quiero que me devuelvan el dinero."),
        (2, "Hello, the parcel is wet.\n- Benjamin"), (3, "el sawwag gal el sa3a 11:30 bas wesel 14:45. My card was frozen for two days."), (4, None), (5, ""), (6, "🎂🎂 12:30 http://a.example/1 @desk"),
        (7, "My mother wrote “merci beaucoup” on the card for nothing."), (8, "Der Fahrer kam erst um acht Uhr. " * 3000), (1, "The driver never came and nobody called me back. Nadie me explicó el cargo en la factura. Quiero que me devuelvan el dinero."),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "message_id long, text string, lang string")
    got = [(r.row_id, [x.lang for x in r.runs]) for r in text_runs(df, profiles, "message_id", "text").collect()]
    assert sorted(got) == [(1, ["en", "es"]), (1, ["en", "es"]), (2, ["en"]), (3, ["ar", "en"]), (7, ["en"]), (8, ["de"])]
    assert all(0 <= x.confidence <= 1 for r in text_runs(df, profiles, "message_id", "text").collect() for x in r.runs)
    assert text_runs(df.limit(0), profiles, "message_id", "text").count() == 0


def test_segments(spark, profiles):
    seg = "array<struct<text:string,t_start:double,t_end:double>>"
    df = spark.createDataFrame([(1, "de", [("Somebody left the parcel outside in the rain.", 0.0, 1.0), ("Personne ne m’a expliqué les frais sur la facture.", 1.0, 2.0)]), (2, "en_GB", [("The lady was rude and hung up on me.", 0.0, 1.0), (None, 1.0, 2.0)]), (3, None, []), (4, None, None)], f"id long, language string, segments {seg}")
    got = {r.row_id: r for r in segment_languages(df, profiles, "id", "segments", "language").collect()}
    assert set(got) == {1, 2} and got[1].lang == "fr" and got[1].named == "de" and [s.lang for s in got[1].segments] == ["en", "fr"]
    assert got[2].named == got[2].lang == "en" and [s.lang for s in got[2].segments] == ["en", "en"]


@pytest.mark.parametrize("label,lang", [("en", "en"), ("EN", "en"), ("en_US", "en"), ("pt-BR", "pt"), ("ger", "de"), ("deu", "de"), ("Urdu", "ur"), (" fra ", "fr"), ("und", None), ("xx", None), ("-", None), ("", None), (None, None)])
def test_labels(label, lang):
    assert L.named_language(label) == lang


def test_empty_fit(spark):
    p = fit_profiles(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert set(p.names) == set(L.TYPED_IN_LATIN)
