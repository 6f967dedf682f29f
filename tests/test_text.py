"""Text columns at their boundaries."""

import pytest
from pyspark.sql import functions as F

from caseloom.functions import text as t


def column(spark, values, f):
    return [r.o for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "value,kind",
    [(None, "empty"), ("", "empty"), (" .,!", "empty"), ("$500", "money"), ("20 dollars", "money"), ("XX/XX/2023", "date"), ("on 3 March", "date"), ("XXXX XXXX", "redaction"), ("XXXX Bank", "redaction"), ("you are in violation", "clause"),
     ("that contributed to this account and my loss", "clause"), ("Fair Debt Collection Practices Act", "phrase"), ("BK-1004", "identifier"), ("12 34", "number"), ("crushed on one side", "phrase"), ("گزارش", "empty")],
)
def test_kinds(spark, value, kind):
    assert column(spark, [value], t.value_kind) == [kind]


def test_names(spark):
    assert column(spark, ["  Charged--Amount! ", None, "__", "É x"], t.snake) == ["charged_amount", None, "", "x"]
    pairs = spark.createDataFrame([("fee", "Overdraft"), ("fee", None), ("fee", "fee"), ("fee", "--")], "h string, q string")
    assert [r.o for r in pairs.select(t.compose_name(F.col("h"), F.col("q")).alias("o")).collect()] == ["overdraft_fee", "fee", "fee", "fee"]
    names = spark.createDataFrame([("overdraft_fee", "fee"), ("fee", "fee"), ("_fee", "fee"), ("x", "fee")], "n string, h string")
    assert [r.o for r in names.select(t.split_qualifier(F.col("n"), F.col("h")).alias("o")).collect()] == ["overdraft", None, None, None]


def test_grounding(spark):
    src = F.lit("The box was crushed on one side at 5pm, order BK-1")
    assert column(spark, ["crushed on one side", "crushed box side", "smashed to bits", "5pm", "", None, "9"], lambda c: t.grounded(c, src)) == [True, True, False, True, False, False, False]
    assert column(spark, ["one-side", "side one", "", None], lambda c: t.extractive(c, src)) == [True, False, False, False]
    assert column(spark, ["one side", "a b c d e", "nothing here"], lambda c: t.kept_qualifier(c, src)) == ["one_side", None, None]
    assert column(spark, ["the box was crushed", "the customer feels sad", None, "an it"], lambda c: t.fault_grounded(c, src)) == [True, False, False, False]
    assert column(spark, ["CRUSHED", "", "absent", None], lambda c: t.locate(c, src)) == [12, None, None, None]


def test_sensitivity_and_masks(spark):
    assert column(spark, ["passport_number", "condition", "blood_type", "my_pin", "status", "creditcardnumber"], t.sensitive_name) == ["government_id", None, "health", "credentials", None, "payment_card"]
    assert column(spark, ["123-45-6789", "4111 1111 1111 1111", "4111 1111 1111 1112", None], t.sensitive_value) == ["government_id", "payment_card", None, None]
    assert column(spark, ["a.b@c.de or +971 50 123 4567", "12345", None, ""], t.masked) == ["«redacted:email» or «redacted:digits»", "12345", None, ""]
    assert column(spark, ["XXXX xx", "", "XXXX Bank"], t.all_redacted) == [True, True, False]


def test_keys_and_media(spark):
    both = spark.createDataFrame([("customer_phone", "+971 (50) 1"), ("phone", "x"), ("order_id", " BK  10 "), ("hotel", "A")], "f string, v string")
    assert [r.o for r in both.select(t.key_value(F.col("f"), F.col("v")).alias("o")).collect()] == ["971501", "", "bk 10", "a"]
    assert column(spark, ["a.PDF", "note.opus", "x", "weird.zzz", "a.b.txt"], t.media_type) == ["application/pdf", "audio/ogg", "application/octet-stream", "application/octet-stream", "text/plain"]
    assert column(spark, ["null", " None ", "", None], t.label) == ["", "none", "", ""]
    assert column(spark, ["a  b 12 XX", "A B 99"], t.fingerprint) == ["a b", "a b"]
    assert column(spark, ["Scanned by X\n\nreal line", None], t.meaningful) == ["real line", None]
    assert column(spark, ["the 2nd order_3", "12", None], t.head_noun) == ["order", None, None]
    long = "word " * 200_000
    assert column(spark, [long], t.value_kind) == ["phrase"]
