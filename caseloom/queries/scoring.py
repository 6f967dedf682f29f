"""Queries that judge predictions: calibration, accuracy, agreement, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions import text as t
from caseloom.operators import calibration as cal
from caseloom.operators import rules
from caseloom.operators.ordered import quantiles, top_k
from caseloom.plans.sizing import broadcast_if_small
from caseloom.sources import labels
from caseloom.sources.tables import table

_GOLD = {"category": "gold_category", "desired_outcome": "gold_desired_outcome", "severity": "gold_severity_signal", "emotion": "gold_emotion_signal"}
TAUS = [0.9, 0.8, 0.7, 0.6]


def _predict(i: int, gold: Column) -> Column:
    """A stand-in for a model: wrong on ids that a stated number divides, null on others."""
    return F.when(F.col("id") % (7 + i) == 0, "other").when(F.col("id") % (11 + i) == 0, None).otherwise(gold)


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "cfpb_labels")
    return c.select("id", "product", *[F.col(g).alias(f) for f, g in _GOLD.items()], *[_predict(i, F.col(g)).alias(f"pred_{f}") for i, (f, g) in enumerate(_GOLD.items())])


def _long(spark: SparkSession, folder: str) -> DataFrame:
    """(id, product, field, gold, predicted, grounding): the labels unpivoted."""
    x = _labels(spark, folder)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("gold"), F.col(f"pred_{f}").alias("predicted")) for f in _GOLD])
    return x.select("id", "product", F.inline(each)).withColumn("grounding", F.lit(1.0) - (F.col("id") % 5) / 10)


def unpivoted_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels and predictions, one row for each field."""
    return _long(spark, folder).select("id", "field", "gold", "predicted")


def calibration_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Reliability of each predicted value with ten labelled rows or more, with the field's default."""
    x = _long(spark, folder)
    cells = cal.reliability(x).join(broadcast_if_small(cal.field_default(x)), "field")
    return cells.select("field", "predicted", "n", F.round("reliability", 6).alias("reliability"), "default_reliability")


def calibrated_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence of every prediction and its route."""
    x = _long(spark, folder)
    y = x.join(broadcast_if_small(cal.reliability(x).select("field", "predicted", "reliability")), ["field", "predicted"], "left").join(broadcast_if_small(cal.field_default(x)), "field", "left")
    fitted = cal.field_default(x).agg(F.count("*") > 0).scalar()
    conf = cal.confidence(F.col("predicted"), F.col("reliability"), F.col("default_reliability"), F.col("grounding"), fitted)
    return y.groupBy("field", cal.route(conf, F.lit(0.8)).alias("route")).agg(F.count("*").alias("n"))


def _category(spark: SparkSession, folder: str) -> DataFrame:
    return cal.leave_one_out(_long(spark, folder).where("field = 'category'"))


def loo_tau(spark: SparkSession, folder: str) -> DataFrame:
    """Least threshold whose accepted rows meet the target, each row scored by the others."""
    return cal.select_tau(cal.accepted_curve(_category(spark, folder)), 0.92).select(F.round("tau", 6).alias("tau"), "gate_met")


def accepted_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Rows accepted and right at every threshold."""
    c = cal.accepted_curve(_category(spark, folder).withColumn("loo", F.round("loo", 6)))
    return c.select("tau", "accepted", "right")


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Cases flagged below each threshold by their least confidence, wrong and right ones."""
    x = cal.leave_one_out(_long(spark, folder))
    cases = x.groupBy("id").agg(F.min("loo").alias("conf"), F.max(1 - F.col("ok")).alias("w")).select("id", F.round("conf", 6).alias("conf"), (F.col("w") == 1).alias("wrong"))
    return cal.sweep(cases, "conf", "wrong", TAUS)


def error_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Upper bound of the error rate of each field."""
    x = _long(spark, folder).where("gold IS NOT NULL AND predicted IS NOT NULL").groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("gold") != F.col("predicted")).alias("errors"))
    return x.withColumn("bound", F.round(cal.error_bound(F.col("errors"), F.col("n")), 6))


def field_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the fields by product and pooled."""
    x = _long(spark, folder).where("gold IS NOT NULL")
    ok = (F.col("gold") == F.coalesce("predicted", F.lit(""))).cast("long")
    return x.withColumn("ok", ok).rollup("field", "product").agg(F.count("*").alias("n"), F.sum("ok").alias("right")).where("field IS NOT NULL")


def zero_edit(spark: SparkSession, folder: str) -> DataFrame:
    """Cases with two labelled fields or more of which none needs an edit."""
    x = _long(spark, folder).where("gold IS NOT NULL").withColumn("ok", F.col("gold") == F.coalesce("predicted", F.lit("")))
    c = x.groupBy("id").agg(F.bool_and("ok").alias("clean"), F.count("*").alias("k")).where("k >= 2")
    return c.agg(F.count("*").alias("cases"), F.count_if("clean").alias("zero_edit"))


def edit_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Edits of each field by direction, and the cases in which it is the only culprit."""
    x = _long(spark, folder).withColumn("g", F.coalesce("gold", F.lit(""))).withColumn("p", F.coalesce("predicted", F.lit(""))).where("g <> p")
    direction = F.when(F.col("p") == "", "missed").when(F.col("g") == "", "invented").otherwise("changed")
    per = x.groupBy("id").agg(F.count("*").alias("wrong"))
    return x.join(per, "id").groupBy("field", direction.alias("direction")).agg(F.count("*").alias("edits"), F.count_if(F.col("wrong") == 1).alias("sole_culprit"))


def confusion_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The fifteen most frequent confusions of each field; the limit is the report's."""
    c = _long(spark, folder).where("gold IS NOT NULL AND predicted IS NOT NULL AND gold <> predicted").groupBy("field", "gold", "predicted").agg(F.count("*").alias("n"))
    return top_k(c, ["field"], [F.desc("n"), F.col("gold"), F.col("predicted")], 15).select("field", "gold", "predicted", "n", "rank")


def majority_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent label of each field, its share, that of the first two, and the rare labels."""
    c = _long(spark, folder).where("gold IS NOT NULL").groupBy("field", "gold").agg(F.count("*").alias("n"))
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "gold")))
    return r.groupBy("field").agg(F.max(F.when(F.col("k") == 1, F.col("gold"))).alias("majority"), F.sum("n").alias("total"), F.sum(F.when(F.col("k") == 1, F.col("n"))).alias("top1"), F.sum(F.when(F.col("k") <= 2, F.col("n"))).alias("top2"), F.count_if(F.col("n") <= 2).alias("rare"))


def class_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of every label."""
    x = _long(spark, folder).where("gold IS NOT NULL")
    return x.groupBy("field", "gold").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("predicted") == F.col("gold"), F.lit(False))).alias("found"))


def label_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of every two label sources on the rows both labelled: the gold, the prediction, and a rater who never says other."""
    x = _long(spark, folder)
    each = F.array(F.struct(F.lit("gold").alias("source"), F.col("gold").alias("label")), F.struct(F.lit("model").alias("source"), F.col("predicted").alias("label")), F.struct(F.lit("rater").alias("source"), F.nullif("predicted", F.lit("other")).alias("label")))
    long = x.select("id", "field", F.inline(each)).where("label IS NOT NULL")
    b = long.select("id", "field", F.col("source").alias("source_b"), F.col("label").alias("label_b"))
    pairs = long.join(b, ["id", "field"]).where("source < source_b")
    return pairs.groupBy("field", F.col("source").alias("source_a"), "source_b").agg(F.count("*").alias("both"), F.count_if(F.col("label") == F.col("label_b")).alias("agree"))


def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of each field by source, the gold ones and the model's, and how many of either meet another label on the other side."""
    x = _long(spark, folder)
    each = F.array(F.struct(F.lit("gold").alias("source"), F.col("gold").alias("label"), F.col("predicted").alias("other")), F.struct(F.lit("model").alias("source"), F.col("predicted").alias("label"), F.col("gold").alias("other")))
    return x.select("field", F.inline(each)).where("label IS NOT NULL").groupBy("field", "source", "label").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("other")).alias("disputed"))


def version_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of old and new predictions against old and new labels."""
    x = _labels(spark, folder).select("id", F.inline(F.array(F.struct(F.lit("new").alias("gold_version"), F.col("category").alias("gold")), F.struct(F.lit("old").alias("gold_version"), F.when(F.col("id") % 13 == 0, "other").otherwise(F.col("category")).alias("gold")))), "pred_category", "category")
    y = x.select("id", "gold_version", "gold", F.inline(F.array(F.struct(F.lit("new").alias("pred_version"), F.col("pred_category").alias("pred")), F.struct(F.lit("old").alias("pred_version"), F.when(F.col("id") % 17 == 0, "other").otherwise(F.col("pred_category")).alias("pred")))))
    return y.where("gold IS NOT NULL").groupBy("gold_version", "pred_version").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))).alias("right"), F.count_if(F.col("pred") == "other").alias("leaks"))


def label_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Which blanks count as labels: only those of a product that uses the field at all."""
    x = _long(spark, folder).groupBy("product", "field").agg(F.count("*").alias("n"), F.count_if(t.label(F.col("gold")) != "").alias("filled"))
    return x.withColumn("blank_labels", F.when(F.col("filled") > 0, F.col("n") - F.col("filled")).otherwise(0))


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """PASS, FAIL or UNMEASURED of each field against a bar of 0.85."""
    x = _long(spark, folder).groupBy("field").agg(F.count_if(F.col("gold").isNotNull()).alias("n"), F.count_if(F.col("gold") == F.col("predicted")).alias("right"))
    return x.select("field", F.when(F.col("n") == 0, "UNMEASURED").when(F.col("right") / F.col("n") >= 0.85, "PASS").otherwise("FAIL").alias("verdict"))


def planted_probes(spark: SparkSession, folder: str) -> DataFrame:
    """How often a value was invented or missed: counts by whether gold and prediction are null."""
    return _long(spark, folder).groupBy("field", F.col("gold").isNull().alias("gold_null"), F.col("predicted").isNull().alias("predicted_null")).agg(F.count("*").alias("n"))


def stratified_first_k(spark: SparkSession, folder: str) -> DataFrame:
    """The first five labels of each product by id: a larger number gives a superset."""
    return top_k(table(spark, folder, "cfpb_labels").select("id", "product"), ["product"], [F.col("id")], 5, "k").select("id", "product")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction documents of a stand-in for a model, as it would write them: none for ids that 19 divides, broken ones where 23 does; of the facts every third is missing, the others are in capitals."""
    x = _labels(spark, folder).join(table(spark, folder, "cfpb_labels").select("id", "gold_key_facts"), "id")
    items = F.filter(F.transform(F.split("gold_key_facts", ";"), F.trim), lambda f: f != "")
    facts = F.transform(F.filter(items, lambda f, i: (F.col("id") + i) % 3 != 0), F.upper)
    governed = F.map_filter(F.create_map(*[c for f in _GOLD for c in (F.lit(f), F.coalesce(F.col(f"pred_{f}"), F.lit("")))]), lambda _, v: v != "")
    doc = F.when(F.col("id") % 23 == 0, "{broken").otherwise(F.to_json(F.struct(governed.alias("governed"), facts.alias("facts"))))
    return x.where("id % 19 <> 0").select("id", doc.alias("line"))


def gold_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Gold labels against the predictions of their id: rows judged and right by field, and those excluded because the prediction is missing or failed."""
    gold = _long(spark, folder).select("id", "field", "gold")
    x = labels.judged(gold, labels.parse_predictions(_documents(spark, folder), "id", "line"))
    read = F.col("status") == "read"
    labelled = F.col("gold").isNotNull()
    return x.groupBy("field").agg(
        F.count_if(read & labelled).alias("judged"), F.count_if(read & labelled & (F.col("gold") == F.coalesce("predicted", F.lit("")))).alias("right"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "missing").alias("missing"),
    )


def key_fact_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Gold facts of each label, and how many have half of their words or more in one predicted fact; labels without a readable prediction are left out."""
    items = F.filter(F.transform(F.split("gold_key_facts", ";"), F.trim), lambda x: x != "")
    gold = table(spark, folder, "cfpb_labels").where("gold_key_facts IS NOT NULL").select("id", items.alias("items"))
    p = labels.parse_predictions(_documents(spark, folder), "id", "line").where("status = 'read'").select("id", "facts")
    have = F.transform(F.coalesce("facts", F.array().cast("array<string>")), lambda f: F.array_distinct(t.tokens(f)))
    want = gold.join(p, "id").select("id", F.explode("items").alias("item"), have.alias("have")).withColumn("want", F.array_distinct(t.tokens(F.col("item"))))
    recalled = F.exists("have", lambda h: F.size(F.array_intersect(F.col("want"), h)) >= 0.5 * F.size("want"))
    return want.groupBy("id").agg(F.count("*").alias("facts"), F.count_if(recalled).alias("recalled"))


def latency_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank half and 95th quantile and interpolated median of the values of each type of event; in two levels, so no type is sorted in one task."""
    n = F.col("n")
    q = quantiles(table(spark, folder, "events"), ["event_type"], "value", {"p50": F.floor(n / 2), "p95": F.floor(n * 0.95), "lo": F.floor((n - 1) / 2)})
    return q.select("event_type", "n", "p50", "p95", F.round((F.col("lo") + F.col("p50")) / 2, 6).alias("median"))


def mode_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Most frequent type of each user's events and the share that agrees."""
    c = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("mode"), F.round(F.max("n") / F.sum("n"), 6).alias("agreement"))


def questions_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Cases by the number of facts left open, each of which asks a question."""
    x = _long(spark, folder).groupBy("id").agg(F.count_if(F.col("gold").isNull()).alias("open"))
    return x.groupBy("open").agg(F.count("*").alias("cases"))


def questions_median(spark: SparkSession, folder: str) -> DataFrame:
    """Interpolated median of the questions of a case, with the most and the number of cases, from the histogram."""
    h = questions_histogram(spark, folder)
    return h.agg(F.sum("cases").alias("cases"), F.max("open").alias("most")).withColumn("median", cal.interpolated_median(h, "open", "cases").scalar())


#: A stated sample policy; a deployment brings its own.
POLICY = rules.parse_policy(
    [
        {"id": "urgent_open", "when": {"o_orderpriority": ["1-URGENT"], "o_orderstatus": ["O", "P"]}, "then": {"level": "P1", "hours": 4.0}},
        {"id": "high", "when": {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, "then": {"level": "P2", "hours": 24.0}},
        {"id": "failed", "when": {"o_orderstatus": ["F"]}, "then": {"level": "P3", "hours": 36.5}},
        {"id": "rest", "then": {"level": "P4", "hours": 72.0}},
    ],
    ["o_orderpriority", "o_orderstatus"],
)


def rules_sla(spark: SparkSession, folder: str) -> DataFrame:
    """Level and due moment of every order by the first rule that matches."""
    o = table(spark, folder, "orders")
    return o.select("o_orderkey", rules.evaluate(POLICY, "level").alias("level"), rules.due(F.col("o_orderdate"), rules.evaluate(POLICY, "hours")).cast("timestamp_ntz").alias("due"))


def rules_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by the rule that decided; none is left without."""
    return table(spark, folder, "orders").groupBy(rules.evaluate(POLICY, "id").alias("rule")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    unpivoted_labels, calibration_fit, calibrated_confidence, loo_tau, accepted_curve, threshold_sweep, error_bounds, field_accuracy, zero_edit, edit_breakdown, confusion_topk, majority_baseline, class_recall,
    label_agreement, label_distribution, version_matrix, label_mask, verdicts, planted_probes, stratified_first_k, key_fact_recall, gold_predictions, latency_quantiles, mode_agreement, questions_histogram, questions_median, rules_sla, rules_audit,
)}

_X = "WITH x AS (" + " UNION ALL ".join(
    f"SELECT id, product, '{f}' AS field, {g} AS gold, CASE WHEN id % {7 + i} = 0 THEN 'other' WHEN id % {11 + i} = 0 THEN NULL ELSE {g} END AS predicted, 1.0::DOUBLE - (id % 5)::DOUBLE / 10 AS grounding FROM cfpb_labels" for i, (f, g) in enumerate(_GOLD.items())
) + ")"
_LOO = """, k AS (SELECT *, (predicted = gold)::INT AS ok FROM x WHERE predicted IS NOT NULL AND gold IS NOT NULL),
    l AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY {p}) > 1 THEN (sum(ok) OVER (PARTITION BY {p}) - ok)::DOUBLE / (count(*) OVER (PARTITION BY {p}) - 1) ELSE 0 END * grounding AS loo FROM k {w})"""
_CAT = _X + _LOO.format(p="field, predicted", w="WHERE field = 'category'")
SQL = {
    "unpivoted_labels": _X + "SELECT id, field, gold, predicted FROM x",
    "calibration_fit": _X + """, k AS (SELECT * FROM x WHERE predicted IS NOT NULL AND gold IS NOT NULL), d AS (SELECT field, round_even(avg((predicted = gold)::INT), 4) AS default_reliability FROM k GROUP BY 1)
        SELECT field, predicted, count(*) AS n, round(avg((predicted = gold)::INT), 6) AS reliability, any_value(default_reliability) AS default_reliability FROM k JOIN d USING (field) GROUP BY 1, 2 HAVING count(*) >= 10""",
    "calibrated_confidence": _X + """, k AS (SELECT * FROM x WHERE predicted IS NOT NULL AND gold IS NOT NULL), d AS (SELECT field, round_even(avg((predicted = gold)::INT), 4) AS dr FROM k GROUP BY 1),
        r AS (SELECT field, predicted, avg((predicted = gold)::INT) AS rel FROM k GROUP BY 1, 2 HAVING count(*) >= 10),
        c AS (SELECT x.field, CASE WHEN x.predicted IS NULL OR trim(x.predicted) IN ('', 'UNCLEAR') THEN 0 ELSE round_even(least(1, greatest(0, coalesce(rel, dr) * grounding)), 4) END AS conf FROM x LEFT JOIN r ON r.field = x.field AND r.predicted = x.predicted LEFT JOIN d ON d.field = x.field)
        SELECT field, CASE WHEN conf >= 0.8 THEN 'auto' ELSE 'review' END AS route, count(*) AS n FROM c GROUP BY 1, 2""",
    "loo_tau": _CAT + """, t AS (SELECT a.loo, avg(b.ok) AS acc FROM (SELECT DISTINCT loo FROM l) a JOIN l b ON b.loo >= a.loo GROUP BY 1)
        SELECT round(coalesce(min(loo), 1.01), 6) AS tau, min(loo) IS NOT NULL AS gate_met FROM t WHERE acc >= 0.92""",
    "accepted_curve": _CAT + """, m AS (SELECT round(loo, 6) AS tau, ok FROM l) SELECT a.tau, count(*) AS accepted, sum(b.ok)::BIGINT AS "right" FROM (SELECT DISTINCT tau FROM m) a JOIN m b ON b.tau >= a.tau GROUP BY 1""",
    "threshold_sweep": _X + _LOO.format(p="field, predicted", w="") + """, c AS (SELECT id, round(min(loo), 6) AS conf, max(1 - ok) = 1 AS wrong FROM l GROUP BY 1)
        SELECT tau::DOUBLE AS tau, count(*) AS cases, count(*) FILTER (conf < tau) AS flagged, count(*) FILTER (conf < tau AND wrong) AS wrong_flagged, count(*) FILTER (conf < tau AND NOT wrong) AS right_flagged, count(*) FILTER (wrong) AS wrong_cases
        FROM c CROSS JOIN (SELECT unnest([0.9, 0.8, 0.7, 0.6]) AS tau) GROUP BY 1""",
    "error_bounds": _X + """, e AS (SELECT field, count(*) AS n, count(*) FILTER (gold <> predicted) AS errors FROM x WHERE gold IS NOT NULL AND predicted IS NOT NULL GROUP BY 1)
        SELECT *, round(CASE WHEN errors = 0 THEN 3 / n ELSE (errors + 2 * sqrt(errors)) / n END, 6) AS bound FROM e""",
    "field_accuracy": _X + """ SELECT field, product, count(*) AS n, count(*) FILTER (gold = coalesce(predicted, '')) AS "right" FROM x WHERE gold IS NOT NULL GROUP BY ROLLUP (field, product) HAVING field IS NOT NULL""",
    "zero_edit": _X + ", c AS (SELECT bool_and(gold = coalesce(predicted, '')) AS clean FROM x WHERE gold IS NOT NULL GROUP BY id HAVING count(*) >= 2) SELECT count(*) AS cases, count(*) FILTER (clean) AS zero_edit FROM c",
    "edit_breakdown": _X + """, w AS (SELECT id, field, coalesce(gold, '') AS g, coalesce(predicted, '') AS p FROM x WHERE coalesce(gold, '') <> coalesce(predicted, '')), k AS (SELECT *, count(*) OVER (PARTITION BY id) AS wrong FROM w)
        SELECT field, CASE WHEN p = '' THEN 'missed' WHEN g = '' THEN 'invented' ELSE 'changed' END AS direction, count(*) AS edits, count(*) FILTER (wrong = 1) AS sole_culprit FROM k GROUP BY 1, 2""",
    "confusion_topk": _X + """, c AS (SELECT field, gold, predicted, count(*) AS n FROM x WHERE gold <> predicted GROUP BY 1, 2, 3)
        SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, gold, predicted) AS rank FROM c QUALIFY rank <= 15""",
    "majority_baseline": _X + """, c AS (SELECT field, gold, count(*) AS n FROM x WHERE gold IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, gold) AS k FROM c)
        SELECT field, max(gold) FILTER (k = 1) AS majority, sum(n)::BIGINT AS total, (sum(n) FILTER (k = 1))::BIGINT AS top1, (sum(n) FILTER (k <= 2))::BIGINT AS top2, count(*) FILTER (n <= 2) AS rare FROM r GROUP BY 1""",
    "class_recall": _X + " SELECT field, gold, count(*) AS n, count(*) FILTER (predicted = gold) AS found FROM x WHERE gold IS NOT NULL GROUP BY 1, 2",
    "label_agreement": _X + """, l AS (SELECT id, field, 'gold' AS source, gold AS label FROM x UNION ALL SELECT id, field, 'model', predicted FROM x UNION ALL SELECT id, field, 'rater', nullif(predicted, 'other') FROM x), k AS (SELECT * FROM l WHERE label IS NOT NULL)
        SELECT a.field, a.source AS source_a, b.source AS source_b, count(*) AS "both", count(*) FILTER (a.label = b.label) AS agree FROM k a JOIN k b ON a.id = b.id AND a.field = b.field AND a.source < b.source GROUP BY 1, 2, 3""",
    "label_distribution": _X + """, l AS (SELECT field, 'gold' AS source, gold AS label, predicted AS other FROM x UNION ALL SELECT field, 'model', predicted, gold FROM x)
        SELECT field, source, label, count(*) AS n, count(*) FILTER (label <> other) AS disputed FROM l WHERE label IS NOT NULL GROUP BY 1, 2, 3""",
    "version_matrix": _X + """, c AS (SELECT id, gold, predicted FROM x WHERE field = 'category'),
        g AS (SELECT id, 'new' AS gold_version, gold, predicted FROM c UNION ALL SELECT id, 'old', CASE WHEN id % 13 = 0 THEN 'other' ELSE gold END, predicted FROM c),
        p AS (SELECT gold_version, gold, 'new' AS pred_version, predicted AS pred FROM g UNION ALL SELECT gold_version, gold, 'old', CASE WHEN id % 17 = 0 THEN 'other' ELSE predicted END FROM g)
        SELECT gold_version, pred_version, count(*) AS n, count(*) FILTER (gold = pred) AS "right", count(*) FILTER (pred = 'other') AS leaks FROM p WHERE gold IS NOT NULL GROUP BY 1, 2""",
    "label_mask": _X + """, c AS (SELECT product, field, count(*) AS n, count(*) FILTER (trim(coalesce(gold, '')) <> '' AND lower(trim(gold)) <> 'null') AS filled FROM x GROUP BY 1, 2) SELECT *, CASE WHEN filled > 0 THEN n - filled ELSE 0 END AS blank_labels FROM c""",
    "verdicts": _X + " SELECT field, CASE WHEN count(gold) = 0 THEN 'UNMEASURED' WHEN count(*) FILTER (gold = predicted) / count(gold) >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM x GROUP BY 1",
    "planted_probes": _X + " SELECT field, gold IS NULL AS gold_null, predicted IS NULL AS predicted_null, count(*) AS n FROM x GROUP BY 1, 2, 3",
    "stratified_first_k": "SELECT id, product FROM cfpb_labels QUALIFY row_number() OVER (PARTITION BY product ORDER BY id) <= 5",
    "gold_predictions": _X + """, empty AS (SELECT id FROM x GROUP BY 1 HAVING count(nullif(predicted, '')) = 0) SELECT field, count(*) FILTER (gold IS NOT NULL AND id % 19 <> 0 AND id % 23 <> 0 AND id NOT IN (SELECT id FROM empty)) AS judged,
        count(*) FILTER (gold IS NOT NULL AND id % 19 <> 0 AND id % 23 <> 0 AND id NOT IN (SELECT id FROM empty) AND gold = coalesce(predicted, '')) AS "right",
        count(*) FILTER (id % 19 <> 0 AND (id % 23 = 0 OR id IN (SELECT id FROM empty))) AS failed, count(*) FILTER (id % 19 = 0) AS missing FROM x GROUP BY 1""",
    "key_fact_recall": _X + """, i AS (SELECT id, list_filter(list_transform(string_split(gold_key_facts, ';'), lambda x: trim(x)), lambda x: x <> '') AS items FROM cfpb_labels WHERE gold_key_facts IS NOT NULL AND id % 19 <> 0 AND id % 23 <> 0),
        p AS (SELECT id, items, [items[k] for k in range(1, len(items) + 1) if (id + k - 1) % 3 <> 0] AS facts FROM i WHERE id NOT IN (SELECT id FROM x GROUP BY 1 HAVING count(nullif(predicted, '')) = 0)),
        h AS (SELECT id, unnest(items) AS item, list_transform(facts, lambda f: list_distinct(regexp_extract_all(lower(f), '[a-z0-9]+'))) AS have FROM p),
        w AS (SELECT id, have, list_distinct(regexp_extract_all(lower(item), '[a-z0-9]+')) AS want FROM h)
        SELECT id, count(*) AS facts, count(*) FILTER (len(list_filter(have, lambda f: len(list_intersect(want, f)) >= 0.5 * len(want))) > 0) AS recalled FROM w GROUP BY 1""",
    "latency_quantiles": """
        WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, any_value(n) AS n, max(value) FILTER (i = n // 2) AS p50, max(value) FILTER (i = floor(n * 0.95)) AS p95, round((max(value) FILTER (i = (n - 1) // 2) + max(value) FILTER (i = n // 2)) / 2, 6) AS median FROM r GROUP BY 1""",
    "mode_agreement": """
        WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, arg_max(event_type, (n, event_type)) AS mode, round(max(n) / sum(n), 6) AS agreement FROM c GROUP BY 1""",
    "questions_histogram": _X + """, c AS (SELECT id, count(*) FILTER (gold IS NULL) AS open FROM x GROUP BY 1) SELECT open, count(*) AS cases FROM c GROUP BY 1""",
    "questions_median": _X + """, c AS (SELECT id, count(*) FILTER (gold IS NULL) AS open FROM x GROUP BY 1) SELECT count(*) AS cases, max(open) AS most, median(open) AS median FROM c""",
    "rules_sla": """
        WITH r AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O', 'P') THEN 1 WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 WHEN o_orderstatus = 'F' THEN 3 ELSE 4 END AS k FROM orders)
        SELECT o_orderkey, 'P' || k AS level, o_orderdate + to_seconds([14400, 86400, 131400, 259200][k]) AS due FROM r""",
    "rules_audit": """
        SELECT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus IN ('O', 'P') THEN 'urgent_open' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'rest' END AS rule, count(*) AS n FROM orders GROUP BY 1""",
}
