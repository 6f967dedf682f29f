"""Queries over the growing schema: support, promotion, backfill, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as t
from caseloom.operators import registry as r
from caseloom.operators.ordered import with_previous
from caseloom.plans.sizing import broadcast_if_small
from caseloom.sources.tables import table

HEADS_FROM, QUALIFIERS_FROM, WIDTH = 4, 8, 20


def _attributes(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "emergent_attribute")
    return a.select("attr_id", "case_id", t.snake(F.col("head")).alias("head"), F.when(t.snake(F.col("qualifier")) != "", t.snake(F.col("qualifier"))).alias("qualifier"), "value", "grounded", "extracted_at")


def support_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of every (head, qualifier) and of every head, each counted anew."""
    a = _attributes(spark, folder)
    fields = r.support(a.where("qualifier IS NOT NULL"), ["head", "qualifier"], "case_id")
    return fields.unionByName(r.support(a, ["head"], "case_id").withColumn("qualifier", F.lit(None).cast("string")))


def head_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of each region, rolled up over its nations by distinct customer and not by sum."""
    c, n, g = (table(spark, folder, x) for x in ("customer", "nation", "region"))
    joined = c.join(broadcast_if_small(n), F.col("c_nationkey") == F.col("n_nationkey")).join(broadcast_if_small(g), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count_distinct("c_custkey").alias("support"), F.count_distinct("n_name").alias("nations"))


def pooled_support(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of each qualifier pooled over its spellings: the singular stands for the plural."""
    a = _attributes(spark, folder).where("qualifier IS NOT NULL").select("qualifier", "case_id")
    aliases = a.select("qualifier").distinct().withColumn("canonical", F.regexp_replace("qualifier", "s$", ""))
    return r.pooled_support(a, aliases, "qualifier", "canonical", "case_id")


def promote_two_level(spark: SparkSession, folder: str) -> DataFrame:
    """Promoted heads, and qualifiers under them; names that are barred as sensitive are not promoted."""
    a = _attributes(spark, folder)
    barred = t.sensitive_name(F.col("head")).isNotNull() | t.sensitive_name(F.coalesce("qualifier", F.lit(""))).isNotNull()
    return r.promote(a, "head", "qualifier", "case_id", HEADS_FROM, QUALIFIERS_FROM, barred)


def backfill_worklist(spark: SparkSession, folder: str) -> DataFrame:
    """The next 25 customers, oldest first, in segments where failed orders are attested, that have no failed order yet."""
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    failed = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    attested = c.join(failed, "c_custkey", "left_semi").select("c_mktsegment").distinct()
    return r.backfill_worklist(c.join(attested, "c_mktsegment", "left_semi"), failed, "c_custkey", ["c_custkey"], 25).select("c_custkey", "c_mktsegment")


def backfill_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Calls to fill all promoted heads in: naive, in every case in their scope, and optimised, without the cases that have them; and the share that is saved."""
    each = backfill_calls(spark, folder)
    total = each.agg(F.count("*").alias("heads"), F.sum("naive_calls").alias("naive_calls"), F.sum("optimised_calls").alias("optimised_calls"))
    return total.withColumn("saved", F.round(1 - F.col("optimised_calls") / F.col("naive_calls"), 6))


def backfill_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls to fill each promoted head in, naive and optimised: in all cases that share a head with a case that has it, and in those of them without it."""
    a = _attributes(spark, folder).select("case_id", "head").distinct()
    heads = r.support(a, ["head"], "case_id").where(F.col("support") >= HEADS_FROM)
    return r.backfill_fanout(a, a.withColumnRenamed("head", "category"), heads, "head", "category", "case_id")


def escape_valve_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts under the escape heads whose value is concrete, by head and kind."""
    a = _attributes(spark, folder).where(F.col("head").isin("other", "description", "document", "reason"))
    k = a.withColumn("kind", t.value_kind(F.col("value")))
    return k.where(t.is_concrete(F.col("kind"))).groupBy("head", "kind").agg(F.count("*").alias("facts"), F.count_distinct("case_id").alias("cases"))


def minted_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary: frequent heads and qualifiers together, without forbidden and sensitive ones."""
    a = _attributes(spark, folder)
    words = r.support(a, ["head"], "case_id").where("support >= 4").select(F.col("head").alias("word")).unionByName(r.support(a.where("qualifier IS NOT NULL"), ["qualifier"], "case_id").where("support >= 4").select(F.col("qualifier").alias("word"))).distinct()
    forbidden = spark.createDataFrame([(w,) for w in ("other", "description", "unnamed", "misc", "miscellaneous", "")], "word string")
    return words.join(broadcast_if_small(forbidden), "word", "left_anti").where(t.sensitive_name(F.col("word")).isNull())


def new_names_per_bucket(spark: SparkSession, folder: str) -> DataFrame:
    """Composed names seen first in each run of 20 rows."""
    a = _attributes(spark, folder).withColumn("name", t.compose_name(F.col("head"), F.col("qualifier")))
    return r.new_names_curve(a.select("attr_id", "name"), "name", "attr_id", [], WIDTH)


def cumulative_names(spark: SparkSession, folder: str) -> DataFrame:
    """The curve of new names with its running total and first difference."""
    c = r.cumulative(new_names_per_bucket(spark, folder), "bucket", "new_names", "names_so_far")
    c = with_previous(c, [], "bucket", [], ["new_names"])
    return c.select("bucket", "new_names", "names_so_far", (F.col("new_names") - F.coalesce("previous.new_names", F.lit(0))).alias("change"))


def canonical_curve(spark: SparkSession, folder: str) -> DataFrame:
    """The curve of new names after qualifiers are folded to their singular."""
    a = _attributes(spark, folder).withColumn("name", t.compose_name(F.col("head"), F.regexp_replace("qualifier", "s$", "")))
    return r.new_names_curve(a.select("attr_id", "name"), "name", "attr_id", [], WIDTH)


def hapax_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Share of composed names that occur once."""
    a = _attributes(spark, folder).withColumn("name", t.compose_name(F.col("head"), F.col("qualifier")))
    return r.hapax(a, ["name"]).select("names", "once", F.round("fraction", 6).alias("fraction"))


def earned_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Names that reach eight rows, by the bucket of rows in which they do."""
    from caseloom.operators.ordered import numbered, top_k

    a = _attributes(spark, folder).withColumn("name", t.compose_name(F.col("head"), F.col("qualifier"))).select("attr_id", "name")
    n = numbered(a, [], "attr_id", [], "n")
    eighth = top_k(n, ["name"], [F.col("n")], QUALIFIERS_FROM, "k").where(F.col("k") == QUALIFIERS_FROM)
    return eighth.groupBy(F.floor((F.col("n") - 1) / WIDTH).alias("bucket")).agg(F.count("*").alias("earned"))


def qualifier_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Share of qualifiers that are leaked values: with a digit, or of four words and more."""
    q = _attributes(spark, folder).where("qualifier IS NOT NULL").select("qualifier").distinct()
    leaked = F.col("qualifier").rlike("[0-9]") | (F.size(F.split("qualifier", "_")) >= 4)
    return q.agg(F.count("*").alias("qualifiers"), F.count_if(leaked).alias("leaked"))


def extracted_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each case after the filter chain: no blank or redacted value, first of each composed name; grounded share by head."""
    from caseloom.operators.ordered import first_by

    a = _attributes(spark, folder).where((F.col("head") != "") & (F.trim("value") != "") & ~t.all_redacted(F.col("value")))
    a = a.withColumn("name", t.compose_name(F.col("head"), F.col("qualifier")))
    kept = first_by(a, ["case_id", "name"], ["attr_id"], ["head", "grounded"])
    return kept.groupBy("head").agg(F.count("*").alias("facts"), F.count_if("grounded").alias("grounded_facts"))


def rehomed_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts under each head before and after the words of the qualifiers that are heads of their own take them over."""
    a = _attributes(spark, folder)
    heads = r.support(a, ["head"], "case_id").where("support >= 4").select(F.col("head").alias("new_head"))
    moved = a.join(broadcast_if_small(heads), F.col("qualifier") == F.col("new_head"), "left")
    before = moved.groupBy("head").agg(F.count("*").alias("before"))
    after = moved.groupBy(F.coalesce("new_head", "head").alias("head")).agg(F.count("*").alias("after"))
    zero = F.lit(0).cast("long")
    return before.join(after, "head", "full_outer").select("head", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"))


QUERIES = {f.__name__: f for f in (
    support_counts, head_rollup, pooled_support, promote_two_level, backfill_worklist, backfill_cost, backfill_calls, escape_valve_facts, minted_vocab, new_names_per_bucket, cumulative_names, canonical_curve,
    hapax_rate, earned_columns, qualifier_leaks, extracted_facts, rehomed_facts,
)}

_SNAKE = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"
_A = f"""
    WITH a AS (SELECT attr_id, case_id, {_SNAKE.format('head')} AS head, nullif({_SNAKE.format('qualifier')}, '') AS qualifier, value, grounded, extracted_at FROM emergent_attribute),
    n AS (SELECT *, CASE WHEN coalesce(qualifier, '') NOT IN ('', head) THEN qualifier || '_' || head ELSE head END AS name, row_number() OVER (ORDER BY attr_id) AS rn FROM a)
"""


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def sensitive_sql(c: str) -> str:
    """The name test in SQL."""
    out = "CASE"
    for category, words in t.SENSITIVE_WORDS.items():
        listed = words.split()
        tests = [f"list_has_any({_tokens(c)}, [{', '.join(repr(w) for w in listed)}])"] + [f"contains(replace(lower({c}), '_', ''), {w.replace('_', '')!r})" for w in listed if "_" in w]
        out += f" WHEN {' OR '.join(tests)} THEN '{category}'"
    return out + " END"


def kind_sql(c: str) -> str:
    """The kind of a value in SQL."""
    v, n = f"trim(coalesce({c}, ''))", f"len({_tokens(c)})"
    words = "[" + ", ".join(repr(w) for w in t.FUNCTION_WORDS) + "]"
    ratio = f"(len(list_filter({_tokens(c)}, lambda x: list_contains({words}, x))) / {n})"
    return f"""CASE WHEN {c} IS NULL OR {n} = 0 THEN 'empty' WHEN regexp_matches(lower({v}), '{t.MONEY}') THEN 'money' WHEN regexp_matches(lower({v}), '{t.DATE}') THEN 'date'
        WHEN len(list_filter({_tokens(c)}, lambda x: regexp_matches(x, '^x+$'))) / {n} >= 0.5 THEN 'redaction'
        WHEN ({n} >= 6 AND {ratio} >= 0.25) OR ({n} >= 4 AND {ratio} >= 0.4) THEN 'clause'
        WHEN regexp_matches({v}, '[0-9]') AND {n} <= 5 THEN CASE WHEN regexp_matches(lower({v}), '[a-z]') THEN 'identifier' ELSE 'number' END ELSE 'phrase' END"""


_CURVE = """
    b AS (SELECT DISTINCT (rn - 1) // 20 AS bucket FROM n),
    f AS (SELECT name, min((rn - 1) // 20) AS bucket FROM {source} GROUP BY 1),
    curve AS (SELECT b.bucket, count(f.name) AS new_names FROM b LEFT JOIN f ON b.bucket = f.bucket GROUP BY 1)
"""
_BACKFILL = """, p AS (SELECT DISTINCT head, case_id FROM a), h AS (SELECT head FROM p GROUP BY 1 HAVING count(*) >= 4),
        s AS (SELECT DISTINCT x.head, y.head AS category FROM p x JOIN p y ON x.case_id = y.case_id WHERE x.head IN (SELECT head FROM h)),
        m AS (SELECT DISTINCT s.head, p.case_id FROM s JOIN p ON p.head = s.category)"""
SQL = {
    "support_counts": _A + "SELECT head, qualifier, count(DISTINCT case_id) AS support FROM a WHERE qualifier IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT head, NULL, count(DISTINCT case_id) FROM a GROUP BY 1",
    "head_rollup": "SELECT r_name, count(DISTINCT c_custkey) AS support, count(DISTINCT n_name) AS nations FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "pooled_support": _A + "SELECT regexp_replace(qualifier, 's$', '') AS canonical, count(DISTINCT case_id) AS support FROM a WHERE qualifier IS NOT NULL GROUP BY 1",
    "promote_two_level": _A + f""", ok AS (SELECT * FROM a WHERE head <> '' AND {sensitive_sql('head')} IS NULL AND {sensitive_sql("coalesce(qualifier, '')")} IS NULL),
        h AS (SELECT head, count(DISTINCT case_id) AS support FROM ok GROUP BY 1 HAVING count(DISTINCT case_id) >= 4)
        SELECT 'head' AS kind, head, NULL AS qualifier, support FROM h
        UNION ALL SELECT 'variant', head, qualifier, count(DISTINCT case_id) FROM ok WHERE qualifier IS NOT NULL AND head IN (SELECT head FROM h) GROUP BY 2, 3 HAVING count(DISTINCT case_id) >= 8""",
    "backfill_worklist": """
        SELECT c_custkey, c_mktsegment FROM customer c WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F')
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'F') ORDER BY c_custkey LIMIT 25""",
    "backfill_cost": _A + _BACKFILL + """, e AS (SELECT m.head, count(*) AS naive, count(*) FILTER (NOT EXISTS (SELECT 1 FROM p WHERE p.head = m.head AND p.case_id = m.case_id)) AS optimised FROM m GROUP BY 1)
        SELECT count(*) AS heads, sum(naive)::BIGINT AS naive_calls, sum(optimised)::BIGINT AS optimised_calls, round(1 - sum(optimised) / sum(naive), 6) AS saved FROM e""",
    "backfill_calls": _A + _BACKFILL + " SELECT m.head, count(*) AS naive_calls, count(*) FILTER (NOT EXISTS (SELECT 1 FROM p WHERE p.head = m.head AND p.case_id = m.case_id)) AS optimised_calls FROM m GROUP BY 1",
    "escape_valve_facts": _A + f""", k AS (SELECT head, case_id, {kind_sql('value')} AS kind FROM a WHERE head IN ('other', 'description', 'document', 'reason'))
        SELECT head, kind, count(*) AS facts, count(DISTINCT case_id) AS cases FROM k WHERE kind IN ('money', 'date', 'number', 'identifier', 'phrase') GROUP BY 1, 2""",
    "minted_vocab": _A + f""", w AS (SELECT head AS word FROM a GROUP BY 1 HAVING count(DISTINCT case_id) >= 4 UNION SELECT qualifier FROM a WHERE qualifier IS NOT NULL GROUP BY 1 HAVING count(DISTINCT case_id) >= 4)
        SELECT word FROM w WHERE word NOT IN ('other', 'description', 'unnamed', 'misc', 'miscellaneous', '') AND {sensitive_sql('word')} IS NULL""",
    "new_names_per_bucket": _A + "," + _CURVE.format(source="n") + "SELECT bucket, new_names FROM curve",
    "cumulative_names": _A + "," + _CURVE.format(source="n") + "SELECT bucket, new_names, sum(new_names) OVER (ORDER BY bucket)::BIGINT AS names_so_far, new_names - lag(new_names, 1, 0) OVER (ORDER BY bucket) AS change FROM curve",
    "canonical_curve": _A + ", m AS (SELECT rn, CASE WHEN coalesce(regexp_replace(qualifier, 's$', ''), '') NOT IN ('', head) THEN regexp_replace(qualifier, 's$', '') || '_' || head ELSE head END AS name FROM n)," + _CURVE.format(source="m") + "SELECT bucket, new_names FROM curve",
    "hapax_rate": _A + ", c AS (SELECT name, count(*) AS k FROM n GROUP BY 1) SELECT count(*) AS names, count(*) FILTER (k = 1) AS once, round(count(*) FILTER (k = 1) / count(*), 6) AS fraction FROM c",
    "earned_columns": _A + ", k AS (SELECT rn, row_number() OVER (PARTITION BY name ORDER BY rn) AS i FROM n) SELECT (rn - 1) // 20 AS bucket, count(*) AS earned FROM k WHERE i = 8 GROUP BY 1",
    "qualifier_leaks": _A + ", q AS (SELECT DISTINCT qualifier FROM a WHERE qualifier IS NOT NULL) SELECT count(*) AS qualifiers, count(*) FILTER (regexp_matches(qualifier, '[0-9]') OR len(string_split(qualifier, '_')) >= 4) AS leaked FROM q",
    "extracted_facts": _A + """, ok AS (SELECT * FROM n WHERE head <> '' AND trim(value) <> '' AND NOT regexp_matches(regexp_replace(lower(value), '[^a-z0-9]+', '', 'g'), '^x*$')),
        k AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY case_id, name ORDER BY attr_id) = 1)
        SELECT head, count(*) AS facts, count(*) FILTER (grounded) AS grounded_facts FROM k GROUP BY 1""",
    "rehomed_facts": _A + """, h AS (SELECT head FROM a GROUP BY 1 HAVING count(DISTINCT case_id) >= 4),
        m AS (SELECT a.head, coalesce(h.head, a.head) AS moved FROM a LEFT JOIN h ON a.qualifier = h.head)
        SELECT coalesce(b.head, c.moved) AS head, coalesce(b.k, 0) AS before, coalesce(c.k, 0) AS after FROM (SELECT head, count(*) AS k FROM m GROUP BY 1) b FULL JOIN (SELECT moved, count(*) AS k FROM m GROUP BY 1) c ON b.head = c.moved""",
}
