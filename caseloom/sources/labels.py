"""Gold labels and predictions: reading, and joining them by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prediction document: labels of the governed fields, and facts.
PREDICTION = "governed map<string,string>, facts array<string>, field_validity double"


def read_gold(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Gold labels of CSV files with a header as (id, field, gold); ``columns`` names the column of each field. Blank labels are null."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(F.trim(F.col(c)), F.lit("")).alias("gold")) for f, c in columns.items()])
    return raw.select("id", F.inline(each))


def parse_predictions(lines: DataFrame, key: str, column: str) -> DataFrame:
    """(key, status, governed, facts, field_validity) of prediction documents: ``failed`` for what is no JSON object or has no labels, else ``read``."""
    doc = F.from_json(F.col(column), PREDICTION)
    ok = F.coalesce(F.size(doc["governed"]) > 0, F.lit(False))
    return lines.select(key, F.when(ok, "read").otherwise("failed").alias("status"), doc["governed"].alias("governed"), doc["facts"].alias("facts"), doc["field_validity"].alias("field_validity"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of JSON lines with an ``id`` each, as :func:`parse_predictions` gives them."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return parse_predictions(lines.select(F.get_json_object("value", "$.id").alias("id"), "value"), "id", "value")


def judged(gold: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Gold rows (key, field, gold) with ``predicted`` and ``status``: read, failed, or missing where no prediction has the key."""
    p = predictions.select(key, "status", "governed")
    out = gold.join(p, key, "left")
    predicted: Column = F.col("governed")[F.col("field")]
    return out.select(*gold.columns, predicted.alias("predicted"), F.coalesce("status", F.lit("missing")).alias("status"))
