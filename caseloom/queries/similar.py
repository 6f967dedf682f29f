"""Queries over vectors and records: neighbours, components, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as t
from caseloom.operators import registry, resolve, vectors
from caseloom.plans.sizing import broadcast_if_small
from caseloom.sources.tables import table

TAU, NEAR = 0.35, 4


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def similarity_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vectors whose cosine is at least the threshold."""
    return vectors.similarity_edges(_vectors(spark, folder), "vec_id", "embedding", TAU).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def components(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every vector in the graph of similar pairs."""
    e = _vectors(spark, folder)
    return vectors.components(vectors.similarity_edges(e, "vec_id", "embedding", TAU), e.select(F.col("vec_id").alias("id")))


def mint_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Components that span at least three distinct labels, which stand for cases; the largest first."""
    e = _vectors(spark, folder).select(F.col("vec_id").alias("id"), "label")
    c = components(spark, folder).join(e, "id")
    return c.groupBy("component").agg(F.count("*").alias("members"), F.count_distinct("label").alias("labels")).where("labels >= 3").orderBy(F.desc("members"), "component")


def knn_top2_margin(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest vector of the same label and its margin over the runner-up, for the query set of ids divisible by 100."""
    e = _vectors(spark, folder)
    near = vectors.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 2, within="label")
    return resolve.top_margin(near).select("id_a", "best", F.round("similarity", 6).alias("similarity"), F.round("margin", 6).alias("margin"))


def knn_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The four nearest vectors of each of the query set."""
    e = _vectors(spark, folder)
    return vectors.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", NEAR).select("id_a", "id_b", "rank", F.round("similarity", 6).alias("similarity"))


def label_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of every vector with the first of its label."""
    e = _vectors(spark, folder)
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return e.join(broadcast_if_small(first), "label").select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), F.col("v")), 6).alias("similarity"))


def dedup_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Band of every vector's nearest neighbour of its label, with the method tally."""
    e = _vectors(spark, folder)
    near = vectors.nearest(e, e, "vec_id", "embedding", 1, within="label")
    all_ = e.select(F.col("vec_id").alias("id_a")).join(near.select("id_a", "similarity"), "id_a", "left")
    return all_.groupBy(registry.dedup_band(F.col("similarity"), 0.40, 0.30).alias("method")).agg(F.count("*").alias("n"))


def canonical_names(spark: SparkSession, folder: str) -> DataFrame:
    """Sequential canonicalisation of the vectors within their labels."""
    e = _vectors(spark, folder).withColumn("name", F.format_string("%08d", "vec_id"))
    return registry.canonicalise(e, "label", "name", "embedding", "vec_id", merge=0.40).withColumn("similarity", F.round("similarity", 6))


def centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy centroid clusters of the vectors within their labels."""
    return vectors.centroid_clusters(_vectors(spark, folder), "label", "vec_id", "embedding", 0.40)


_FIELDS = ["order_id", "phone", "customer_name", "items", "slot", "delivered_at"]


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.melt(table(spark, folder, "spike_bakery_objects"), "object_id", _FIELDS)


def key_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Profile of every column of the uploaded records, keys first by uniqueness."""
    p = resolve.profile_fields(_cells(spark, folder))
    return p.select("field", "filled", "distinct_values", F.round("uniqueness", 6).alias("uniqueness"), F.round("contact_share", 6).alias("contact_share"), "is_key").orderBy(F.desc("uniqueness"), "field")


def external_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Display id of every uploaded record."""
    cells = _cells(spark, folder)
    return resolve.external_ids(cells, resolve.profile_fields(cells), "object_id")


def key_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Lookup hashes of the identifiers of every record; both ``phone`` and ``customer_phone`` are phones."""
    c = _cells(spark, folder).where(F.col("field").isin("order_id", "phone"))
    v = t.key_value(F.when(F.col("field") == "phone", "customer_phone").otherwise(F.col("field")), F.col("value"))
    return c.select("object_id", "field", F.sha2(v, 256).alias("key_hash")).where(v != "")


def object_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Text of every record for the fuzzy match: all columns but contacts and blanks."""
    o = table(spark, folder, "spike_bakery_objects")
    parts = [F.when(F.trim(F.col(f)) != "", F.trim(F.col(f))) for f in _FIELDS if f != "phone"]
    return o.select("object_id", F.concat_ws(" ", *parts).alias("text"))


def anchor_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome of resolving every record's own order number and phone against all records of its tenant."""
    o = table(spark, folder, "spike_bakery_objects").select("object_id", "tenant_id", t.key_value(F.lit("order_id"), F.col("order_id")).alias("oid"), F.when(F.trim("phone") != "", t.key_value(F.lit("phone"), F.col("phone"))).alias("ph"))
    by_id = o.groupBy("tenant_id", "oid").agg(F.count_distinct("object_id").alias("id_hits"), F.min("object_id").alias("id_object"))
    by_ph = o.where("ph IS NOT NULL").groupBy("tenant_id", "ph").agg(F.count_distinct("object_id").alias("ph_hits"))
    target = o.select(F.col("object_id").alias("id_object"), F.col("ph").alias("target_ph"))
    x = o.join(by_id, ["tenant_id", "oid"], "left").join(by_ph, ["tenant_id", "ph"], "left").join(target, "id_object", "left")
    agrees = F.coalesce(F.col("target_ph") == F.col("ph"), F.lit(False))
    out = resolve.resolve_outcome(F.col("oid"), F.coalesce("id_hits", F.lit(0)), F.col("ph"), F.coalesce("ph_hits", F.lit(0)), agrees)
    return x.select("object_id", out.alias("outcome"))


def match_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of outcomes, and the share bound silently, by tenant."""
    r = anchor_resolution(spark, folder).join(table(spark, folder, "spike_bakery_objects").select("object_id", "tenant_id"), "object_id")
    return r.groupBy("tenant_id").agg(F.count("*").alias("cases"), F.count_if(F.col("outcome") == "silent").alias("silent"), F.count_if(F.col("outcome") == "confirm").alias("confirm"), F.round(F.avg((F.col("outcome") == "silent").cast("double")), 6).alias("silent_rate"))


def name_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Records found again by their customer's name alone, for the query set of ids divisible by 100, judged by the record itself: silent and wrong binds, recall of those that ought to bind, and behaviour, by tenant."""
    o = table(spark, folder, "spike_bakery_objects").select("object_id", "tenant_id", "customer_name")
    probes = o.where("object_id % 100 = 0")
    same = o.groupBy("tenant_id", F.lower(F.trim("customer_name")).alias("typed")).agg(F.count("*").alias("of_name"))
    truth = probes.withColumn("typed", F.lower(F.trim("customer_name"))).join(same, ["tenant_id", "typed"], "left")
    true_mode = F.when((F.col("typed") != "") & (F.col("of_name") == 1), "silent").otherwise("confirm")
    judged = truth.select("object_id", "tenant_id", true_mode.alias("true_mode"), F.when(true_mode == "silent", F.col("object_id")).alias("true_object")).join(resolve.resolve_by_name(probes, o, "object_id", "tenant_id", "customer_name"), "object_id")
    return resolve.match_quality(judged, ["tenant_id"], "mode", "bound", "true_mode", "true_object")


QUERIES = {f.__name__: f for f in (
    similarity_edges, components, mint_candidates, knn_top2_margin, knn_neighbours, label_cosine, dedup_gate, canonical_names, centroid_clusters, key_profile, external_ids, key_hashes, object_texts, anchor_resolution, match_metrics, name_resolution,
)}

_COS = "(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))))"
_EDGES = f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, {_COS} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} >= {TAU}"
_COMPONENTS = f"""
    WITH RECURSIVE e AS MATERIALIZED ({_EDGES}), both_ways AS MATERIALIZED (SELECT id_a AS u, id_b AS v FROM e UNION SELECT id_b, id_a FROM e),
    reach AS (SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT r.id, b.v FROM reach r JOIN both_ways b ON b.u = r.seen),
    comp AS (SELECT id, min(seen) AS component FROM reach GROUP BY 1)
"""
_CELLS = "WITH cells AS (" + " UNION ALL ".join(f"SELECT object_id, '{f}' AS field, trim({f}) AS value FROM spike_bakery_objects WHERE trim({f}) <> ''" for f in _FIELDS) + ")"
_CONTACT = "(regexp_matches(value, '^[^@ \\t\\n]+@[^@ \\t\\n]+\\.[^@ \\t\\n]+$') OR regexp_matches(value, '^[+(]?[0-9][0-9 \\t().-]{6,}$'))"
_KEYNAME = "regexp_matches(lower(field), '(^|_)(phone|mobile|tel|cell|email|msisdn)(_|$)')"
_IDNAME = "regexp_matches(lower(field), '(^|_)(id|ref|reference|code|number|sku|barcode|ticket|uuid|guid)(_|$)')"
_PROFILE = f"""{_CELLS}, p AS (SELECT field, count(*) AS filled, count(DISTINCT value) AS distinct_values, count(DISTINCT value) / count(*) AS uniqueness, count(*) FILTER ({_CONTACT}) / count(*) AS contact_share FROM cells GROUP BY 1),
    prof AS (SELECT *, uniqueness >= 0.9 OR contact_share >= 0.8 OR {_KEYNAME} AS is_key FROM p)"""
_RESOLVE = """
    WITH o AS (SELECT object_id, tenant_id, lower(trim(regexp_replace(order_id, '[ \\t\\n\\r]+', ' ', 'g'))) AS oid, CASE WHEN trim(phone) <> '' THEN regexp_replace(phone, '[^0-9]', '', 'g') END AS ph FROM spike_bakery_objects),
    i AS (SELECT tenant_id, oid, count(DISTINCT object_id) AS id_hits, min(object_id) AS id_object FROM o GROUP BY 1, 2),
    h AS (SELECT tenant_id, ph, count(DISTINCT object_id) AS ph_hits FROM o WHERE ph IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT o.object_id, o.tenant_id, CASE WHEN o.oid IS NOT NULL THEN CASE WHEN id_hits = 1 AND coalesce(ph_hits, 0) > 0 AND NOT coalesce(x.ph = o.ph, false) THEN 'confirm' WHEN id_hits = 1 THEN 'silent' ELSE 'confirm' END
        WHEN o.ph IS NOT NULL AND ph_hits = 1 THEN 'silent' WHEN o.ph IS NOT NULL AND ph_hits > 1 THEN 'confirm' ELSE 'elicit' END AS outcome
        FROM o LEFT JOIN i ON i.tenant_id = o.tenant_id AND i.oid = o.oid LEFT JOIN h ON h.tenant_id = o.tenant_id AND h.ph = o.ph LEFT JOIN o x ON x.object_id = i.id_object)
"""
SQL = {
    "similarity_edges": f"SELECT id_a, id_b, round(similarity, 6) AS similarity FROM ({_EDGES})",
    "components": _COMPONENTS + "SELECT id, component FROM comp",
    "mint_candidates": _COMPONENTS + "SELECT component, count(*) AS members, count(DISTINCT label) AS labels FROM comp JOIN embeddings ON vec_id = id GROUP BY 1 HAVING count(DISTINCT label) >= 3",
    "knn_top2_margin": f"""
        WITH p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS nxt FROM p WINDOW w AS (PARTITION BY id_a ORDER BY s DESC, id_b))
        SELECT id_a, id_b AS best, round(s, 6) AS similarity, round(s - coalesce(nxt, 0), 6) AS margin FROM r WHERE k = 1""",
    "knn_neighbours": f"""
        WITH p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        SELECT id_a, id_b, row_number() OVER (PARTITION BY id_a ORDER BY s DESC, id_b) AS rank, round(s, 6) AS similarity FROM p QUALIFY rank <= {NEAR}""",
    "label_cosine": f"""
        WITH f AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) SELECT a.vec_id, a.label, round({_COS}, 6) AS similarity FROM embeddings a JOIN f b ON a.label = b.label""",
    "dedup_gate": f"""
        WITH p AS (SELECT a.vec_id AS id, max({_COS}) AS s FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1)
        SELECT CASE WHEN s IS NULL THEN 'seed' WHEN s >= 0.40 THEN 'merge' WHEN s < 0.30 THEN 'admit_new' ELSE 'adjudicate' END AS method, count(*) AS n FROM p GROUP BY 1""",
    "canonical_names": """
        WITH RECURSIVE r AS MATERIALIZED (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, printf('%08d', vec_id) AS name, embedding::DOUBLE[] AS e FROM embeddings),
        s AS (SELECT label, k, name, [{'n': name, 'e': e}] AS kept, name AS canonical, 0.0::DOUBLE AS similarity, 'seed' AS method FROM r WHERE k = 1
            UNION ALL SELECT label, k, name, CASE WHEN sim >= 0.40 THEN kept ELSE list_append(kept, {'n': name, 'e': e}) END, CASE WHEN sim >= 0.40 THEN kept[list_position(sims, sim)].n ELSE name END, sim, CASE WHEN sim >= 0.40 THEN 'merge' ELSE 'admit_new' END
            FROM (SELECT *, list_max(sims) AS sim FROM (SELECT r.label, r.k, r.name, r.e, s.kept, list_transform(s.kept, lambda x: list_cosine_similarity(x.e, r.e)) AS sims FROM s JOIN r ON r.label = s.label AND r.k = s.k + 1)))
        SELECT label::VARCHAR AS head, name, canonical, round(similarity, 6) AS similarity, method FROM s""",
    "centroid_clusters": """
        WITH RECURSIVE u AS MATERIALIZED (SELECT label, vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
        r AS MATERIALIZED (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, vec_id, e FROM u),
        s AS (SELECT label, k, vec_id, [e] AS sums, 0::BIGINT AS cluster FROM r WHERE k = 1
            UNION ALL SELECT label, k, vec_id, CASE WHEN sim >= 0.40 THEN list_transform(sums, lambda x, i: CASE WHEN i = pos THEN list_transform(list_zip(x, e), lambda z: z[1] + z[2]) ELSE x END) ELSE list_append(sums, e) END, CASE WHEN sim >= 0.40 THEN pos - 1 ELSE len(sums) END
            FROM (SELECT *, list_max(sims) AS sim, list_position(sims, list_max(sims)) AS pos FROM (SELECT r.label, r.k, r.vec_id, r.e, s.sums, list_transform(s.sums, lambda x: list_cosine_similarity(x, r.e)) AS sims FROM s JOIN r ON r.label = s.label AND r.k = s.k + 1)))
        SELECT label::VARCHAR AS g, vec_id AS id, cluster::INT AS cluster FROM s""",
    "key_profile": _PROFILE + "SELECT field, filled, distinct_values, round(uniqueness, 6) AS uniqueness, round(contact_share, 6) AS contact_share, is_key FROM prof",
    "external_ids": _PROFILE + f"""SELECT object_id, field, value FROM cells JOIN prof USING (field) WHERE is_key
        QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY CASE WHEN {_IDNAME} AND NOT {_KEYNAME} THEN 0 WHEN NOT {_KEYNAME} THEN 1 ELSE 2 END, uniqueness DESC, field) = 1""",
    "key_hashes": """
        SELECT object_id, 'phone' AS field, sha256(regexp_replace(phone, '[^0-9]', '', 'g')) AS key_hash FROM spike_bakery_objects WHERE trim(phone) <> '' AND regexp_replace(phone, '[^0-9]', '', 'g') <> ''
        UNION ALL SELECT object_id, 'order_id', sha256(lower(trim(regexp_replace(trim(order_id), '[ \\t\\n\\r]+', ' ', 'g')))) FROM spike_bakery_objects WHERE trim(order_id) <> ''""",
    "object_texts": "SELECT object_id, concat_ws(' ', nullif(trim(order_id), ''), nullif(trim(customer_name), ''), nullif(trim(items), ''), nullif(trim(slot), ''), nullif(trim(delivered_at), '')) AS text FROM spike_bakery_objects",
    "anchor_resolution": _RESOLVE + "SELECT object_id, outcome FROM r",
    "match_metrics": _RESOLVE + "SELECT tenant_id, count(*) AS cases, count(*) FILTER (outcome = 'silent') AS silent, count(*) FILTER (outcome = 'confirm') AS confirm, round(count(*) FILTER (outcome = 'silent') / count(*), 6) AS silent_rate FROM r GROUP BY 1",
}
