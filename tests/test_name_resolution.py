"""The name as third step of resolution, and its measures."""

from pyspark.sql import functions as F

from caseloom.operators import resolve


def test_name_decides_only_after_id_and_phone(spark):
    cols = "anchor string, ih long, phone string, ph long, agrees boolean, s double, m double"
    rows = [(None, 0, None, 0, False, 0.8, 0.1), (None, 0, "p", 0, False, 0.8, 0.01), (None, 0, None, 0, False, 0.5, 0.5), (None, 0, None, 0, False, None, None), ("a", 0, None, 0, False, 0.9, 0.9), (None, 0, "p", 2, False, 0.9, 0.9)]
    out = spark.createDataFrame(rows, cols).select(resolve.resolve_with_name(*[F.col(c) for c in ("anchor", "ih", "phone", "ph", "agrees", "s", "m")]).alias("o"))
    assert [r.o for r in out.collect()] == ["silent", "confirm", "elicit", "elicit", "confirm", "confirm"]


def test_match_quality(spark):
    rows = [("silent", 1, "silent", 1), ("silent", 2, "silent", 3), ("silent", 4, "confirm", None), ("elicit", None, "confirm", None), ("confirm", None, "silent", 5)]
    df = spark.createDataFrame(rows, "mode string, bound long, true_mode string, truth long")
    assert tuple(resolve.match_quality(df, [], "mode", "bound", "true_mode", "truth").first()) == (5, 3, 2, 3, 2, 3)
