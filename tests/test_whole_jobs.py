"""Queries that take all rows and texts, where narrower ones beside them take a part."""

from caseloom.queries import registry


def planted(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_every_line_and_language_is_profiled(spark, tmp_path):
    rows = [(1, "en", "complaint_narrative", "late fee\n$5\n\nthe box broke. the box"), (2, "ur", "complaint_narrative", "order 12. again order"), (3, None, "email", "a\nb"), (4, "fr", "email", None)]
    folder = planted(spark, tmp_path, "documents", rows, "doc_id long, lang string, source string, text string")
    got = {(r.lang, r.kind): r.n for r in registry.QUERIES["document_profile"](spark, folder).collect()}
    assert sum(got.values()) == 4 + 1 + 2
    assert got[("en", "money")] == 1 and got[("en", "empty")] == 1 and ("ur", "identifier") in got and (None, "phrase") in got
    assert {r.doc_id: r.lang for r in registry.QUERIES["fault_grounding"](spark, folder).collect()} == {1: "en", 2: "ur", 3: None, 4: "fr"}


def test_backfill_calls_keep_to_cases_in_scope(spark, tmp_path):
    rows = [(c, h) for c, hs in {"c1": "a b", "c2": "a", "c3": "a", "c4": "a", "c5": "b", "c6": "d e", "c7": "d", "c8": "d", "c9": "d"}.items() for h in hs.split()]
    folder = planted(spark, tmp_path, "emergent_attribute", [(i, c, h, None, "v", True, None) for i, (c, h) in enumerate(rows)], "attr_id long, case_id string, head string, qualifier string, value string, grounded boolean, extracted_at timestamp")
    got = {tuple(r) for r in registry.QUERIES["backfill_calls"](spark, folder).select("head", "naive_calls", "optimised_calls").collect()}
    assert got == {("a", 5, 1), ("d", 4, 0)}
