"""Calibrated confidence from labelled predictions."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators.ordered import prefix_sum


def reliability(rows: DataFrame, least: int = 10) -> DataFrame:
    """(field, predicted, n, reliability): share right of each predicted value with at least ``least`` labelled rows. Nulls on either side do not count."""
    known = rows.where(F.col("predicted").isNotNull() & F.col("gold").isNotNull())
    cells = known.groupBy("field", "predicted").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("gold")).alias("right"))
    return cells.where(F.col("n") >= least).select("field", "predicted", "n", (F.col("right") / F.col("n")).alias("reliability"))


def field_default(rows: DataFrame) -> DataFrame:
    """(field, default_reliability): share right of each field, to four places, for values without a cell."""
    known = rows.where(F.col("predicted").isNotNull() & F.col("gold").isNotNull())
    return known.groupBy("field").agg(F.bround(F.avg((F.col("predicted") == F.col("gold")).cast("double")), 4).alias("default_reliability"))


#: Confidence per unit of grounding where nothing is calibrated at all.
UNFITTED = 0.4
#: A threshold that no confidence reaches.
UNREACHABLE = 1.01


def confidence(value: Column, known_reliability: Column, default: Column, grounding: Column, fitted: Column | bool = True) -> Column:
    """Confidence from 0 to 1: 0 for an abstention; reliability times grounding; grounding alone for a field without calibration among calibrated ones; ``UNFITTED`` times grounding where nothing is ``fitted``, so that a lost calibration reads as uncertain."""
    rel = F.coalesce(known_reliability, default)
    known = F.lit(fitted) if isinstance(fitted, bool) else fitted
    raw = F.when(~known, UNFITTED * grounding).when(rel.isNull(), grounding).otherwise(rel * grounding)
    abstains = value.isNull() | F.trim(value).isin("", "UNCLEAR")
    return F.when(abstains, 0.0).otherwise(F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 4))


def route(conf: Column, tau: Column) -> Column:
    """auto at or above the threshold, else review."""
    return F.when(conf >= tau, "auto").otherwise("review")


def load_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, float]:
    """A calibration stored as JSON: (cells of field, predicted, reliability; defaults of field, default_reliability; threshold).

    The document is ``{"tau": t, "fields": {name: {"default": d, "reliability":
    {value: r}}}}``. A file that is missing, no JSON or without fields gives empty
    frames and a threshold that nothing reaches, so everything goes to review.
    """
    fields, tau = {}, UNREACHABLE
    try:
        doc = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))  # one small document
        fields = {str(k): (float(v["default"]), {str(x): float(y) for x, y in v["reliability"].items()}) for k, v in doc["fields"].items()}
        tau = float(doc.get("tau", UNREACHABLE)) if fields else UNREACHABLE
    except (AnalysisException, json.JSONDecodeError, KeyError, TypeError, ValueError, AttributeError):
        fields, tau = {}, UNREACHABLE
    cells = spark.createDataFrame([(k, x, y) for k, (_, rel) in fields.items() for x, y in rel.items()], "field string, predicted string, reliability double")
    return cells, spark.createDataFrame([(k, d) for k, (d, _) in fields.items()], "field string, default_reliability double"), tau


def leave_one_out(rows: DataFrame) -> DataFrame:
    """Rows with ``loo``: the share right among the *other* rows of the same field and prediction, times grounding; from the group's totals less the row itself, without a self-join."""
    known = rows.where(F.col("predicted").isNotNull() & F.col("gold").isNotNull())
    totals = known.groupBy("field", "predicted").agg(F.count("*").alias("_n"), F.count_if(F.col("predicted") == F.col("gold")).alias("_r"))
    own = (F.col("predicted") == F.col("gold")).cast("long")
    share = F.when(F.col("_n") > 1, (F.col("_r") - own) / (F.col("_n") - 1)).otherwise(0.0)
    return known.join(totals, ["field", "predicted"]).withColumn("ok", own).withColumn("loo", share * F.col("grounding")).drop("_n", "_r")


def interpolated_median(counts: DataFrame, value: str, n: str) -> DataFrame:
    """(median) of values given with their numbers of rows: the middle one, or the mean of the two in the middle; null without rows."""
    upto = prefix_sum(counts, [], value, [], F.col(n), "_upto").withColumn("_all", counts.agg(F.sum(n)).scalar())
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    return upto.agg(at(F.floor((F.col("_all") - 1) / 2)).alias("_lo"), at(F.floor(F.col("_all") / 2)).alias("_hi")).select(((F.col("_lo") + F.col("_hi")) / 2).alias("median"))


def accepted_curve(scored: DataFrame, conf: str = "loo", ok: str = "ok") -> DataFrame:
    """(tau, accepted, right, accuracy) at every distinct confidence; equal ones enter together.

    Rows are counted by confidence first; the ordered window runs over those counts.
    """
    levels = scored.groupBy(F.col(conf).alias("tau")).agg(F.count("*").alias("n"), F.sum(ok).alias("r"))
    down = Window.orderBy(F.desc("tau")).rowsBetween(Window.unboundedPreceding, 0)
    curve = levels.select("tau", F.sum("n").over(down).alias("accepted"), F.sum("r").over(down).alias("right"))
    return curve.withColumn("accuracy", F.col("right") / F.col("accepted"))


def select_tau(curve: DataFrame, target: float) -> DataFrame:
    """(tau, gate_met): the least threshold whose accepted rows meet the target; 1.01, which nothing reaches, if none does."""
    best = curve.agg(F.min(F.when(F.col("accuracy") >= target, F.col("tau"))).alias("t"))
    return best.select(F.coalesce("t", F.lit(UNREACHABLE)).alias("tau"), F.col("t").isNotNull().alias("gate_met"))


def sweep(cases: DataFrame, conf: str, wrong: str, taus: list[float]) -> DataFrame:
    """(tau, cases, flagged, wrong_flagged, right_flagged, wrong_cases) at each threshold: a case is flagged below it."""
    each = cases.select(F.explode(F.array(*[F.lit(x) for x in taus])).alias("tau"), F.col(conf).alias("_c"), F.col(wrong).alias("_w"))
    flagged = F.col("_c") < F.col("tau")
    return each.groupBy("tau").agg(
        F.count("*").alias("cases"), F.count_if(flagged).alias("flagged"), F.count_if(flagged & F.col("_w")).alias("wrong_flagged"),
        F.count_if(flagged & ~F.col("_w")).alias("right_flagged"), F.count_if(F.col("_w")).alias("wrong_cases"),
    )


def error_bound(errors: Column, n: Column) -> Column:
    """Upper bound of an error rate: three over n without errors, else errors plus two of their roots over n."""
    return F.when(n == 0, None).when(errors == 0, 3 / n).otherwise((errors + 2 * F.sqrt(errors)) / n)
