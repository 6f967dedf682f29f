"""Queries over texts: kinds of values, grounding, spans, masks, chat lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as t
from caseloom.operators.ordered import numbered, top_k
from caseloom.operators.provenance import located_values
from caseloom.queries.schema_growth import kind_sql, sensitive_sql
from caseloom.sources.tables import table


def value_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Kind and share of function words of every attribute's value, counted."""
    a = table(spark, folder, "emergent_attribute").withColumn("kind", t.value_kind(F.col("value")))
    return a.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(t.function_ratio(F.col("value"))), 6).alias("mean_ratio"))


def document_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of every line of every document, by language."""
    d = table(spark, folder, "documents").select("lang", F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("kind", t.value_kind(F.col("line")))
    return d.groupBy("lang", "kind").agg(F.count("*").alias("n"))


def normal_names(spark: SparkSession, folder: str) -> DataFrame:
    """Part names composed with their brand and split again."""
    p = table(spark, folder, "part").select("p_partkey", t.snake(F.col("p_type")).alias("head"), F.col("p_brand").alias("brand"))
    p = p.withColumn("name", t.compose_name(F.col("head"), F.col("brand")))
    return p.select("p_partkey", "name", t.split_qualifier(F.col("name"), F.col("head")).alias("qualifier"), t.head_noun(F.col("head")).alias("noun"))


def grounded_values(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the agreed facts of a complaint are in its product and outcome words: by field, with the share that are."""
    c = table(spark, folder, "cfpb_labels").where("gold_key_facts IS NOT NULL")
    source = F.concat_ws(" ", "product", "gold_category", "gold_desired_outcome", "gold_severity_signal", "gold_emotion_signal", "gold_key_facts")
    items = c.select("id", F.explode(F.split("gold_key_facts", ";")).alias("item"), source.alias("source"))
    items = items.select("id", F.trim(F.substring_index("item", "=", 1)).alias("name"), F.trim(F.substring_index("item", "=", -1)).alias("value"), "source").where("value <> ''")
    return items.groupBy("name").agg(F.count("*").alias("n"), F.count_if(t.grounded(F.col("value"), F.col("source"))).alias("grounded"), F.count_if(t.extractive(F.col("name"), F.col("source"))).alias("extractive"))


def kept_qualifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Qualifiers that stay: short ones that are words of the attribute's own value or head."""
    a = table(spark, folder, "emergent_attribute")
    q = t.kept_qualifier(F.col("qualifier"), F.concat_ws(" ", "head", "value", "qualifier"))
    return a.select(q.alias("qualifier")).groupBy("qualifier").agg(F.count("*").alias("n"))


def fault_grounding(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document's first sentence is told in the rest of it, in every language and source."""
    fault = F.substring_index("text", ".", 1)
    return table(spark, folder, "documents").select("doc_id", "lang", t.fault_grounded(fault, F.col("text")).alias("grounded"), F.size(t.content_words(fault)).alias("words"))


def locate_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every attested value in its case's documents: the first document that has it, and offsets in the case's joined text."""
    d = table(spark, folder, "documents").where("case_id IS NOT NULL")
    return located_values(table(spark, folder, "emergent_attribute"), d, "case_id", "value", "doc_id", "text")


def case_text_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The joined text of each case in parts of 50 documents, so that no case has to fit in one row: length and hash of each part."""
    d = table(spark, folder, "documents").where("case_id IS NOT NULL AND text <> ''").select("case_id", "doc_id", "text")
    n = numbered(d, ["case_id"], "doc_id", [], "n").withColumn("part_no", F.floor((F.col("n") - 1) / 50))
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
    return n.groupBy("case_id", "part_no").agg(F.count("*").alias("documents"), part.alias("text")).select("case_id", "part_no", "documents", F.length("text").alias("length"), F.sha2("text", 256).alias("sha"))


def text_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised messages and transcripts: whole-text spans by characters, segments by time."""
    m = table(spark, folder, "inbound_message").where("text IS NOT NULL").select(F.lit("text").alias("kind"), F.col("message_id").alias("id"), F.lit(1).cast("long").alias("spans"), F.length("text").cast("double").alias("reach"))
    s = table(spark, folder, "transcript").select(F.lit("audio").alias("kind"), F.col("transcript_id").alias("id"), F.size("segments").cast("long").alias("spans"), F.array_max(F.transform("segments", lambda x: x["t_end"])).alias("reach"))
    return m.unionByName(s)


def sensitive_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Category of every attested head and qualifier by name, and of its values by shape."""
    a = table(spark, folder, "emergent_attribute")
    words = a.select(t.snake(F.col("head")).alias("name"), "value").unionByName(a.select(t.snake(F.col("qualifier")).alias("name"), "value")).where("name <> ''")
    c = F.coalesce(t.sensitive_name(F.col("name")), t.sensitive_value(F.col("value")))
    return words.groupBy(F.coalesce(c, F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


def card_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and facts with long digit runs, and how many of these pass the check sum."""
    f = table(spark, folder, "inbound_message").select("text").unionByName(table(spark, folder, "cfpb_labels").select(F.col("gold_key_facts").alias("text"))).where("text IS NOT NULL")
    runs = F.size(F.regexp_extract_all("text", F.lit(r"[0-9](?:[ -]?[0-9]){12,18}"), F.lit(0)))
    return f.agg(F.count("*").alias("texts"), F.count_if(runs > 0).alias("with_runs"), F.sum(F.size(t.card_numbers(F.col("text")))).alias("cards"))


def masked_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with addresses and long digit runs masked."""
    return table(spark, folder, "cfpb_labels").select("id", t.masked(F.col("gold_key_facts")).alias("facts"))


def redacted_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values by head that are nothing but placeholders."""
    a = table(spark, folder, "emergent_attribute")
    return a.groupBy("head").agg(F.count_if(t.all_redacted(F.regexp_replace("value", "[0-9]", "X"))).alias("redacted"), F.count("*").alias("n"))


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents kept after the near-duplicate key, the first of each."""
    d = table(spark, folder, "documents").select("doc_id", F.sha2(t.fingerprint(F.col("text")), 256).alias("print"))
    return d.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def boilerplate_strip(spark: SparkSession, folder: str) -> DataFrame:
    """Length of each scanned letter without boilerplate, and whether a text layer is enough."""
    d = table(spark, folder, "documents").where("source = 'scanned_letter'").withColumn("m", t.meaningful(F.col("text")))
    return d.select("doc_id", F.length("m").alias("length"), (F.length("m") >= 40).alias("digital"))


def length_band(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each source within the length bands of the collectors."""
    d = table(spark, folder, "documents")
    return d.groupBy("source").agg(F.count_if(F.length("text").between(120, 1400)).alias("band_a"), F.count_if(F.length("text").between(180, 1400)).alias("band_b"))


def greedy_caps(spark: SparkSession, folder: str) -> DataFrame:
    """First-come choice: at most two of each (language, source), then at most nine of each language."""
    d = table(spark, folder, "documents").select("doc_id", "lang", "source")
    two = top_k(d, ["lang", "source"], [F.col("doc_id")], 2, "a")
    return top_k(two, ["lang"], [F.col("doc_id")], 9, "b").select("doc_id", "lang", "source")


def held_out(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are held out: neither the id nor the near-duplicate key is among the e-mails'."""
    d = table(spark, folder, "documents").select("doc_id", "source", F.sha2(t.fingerprint(F.col("text")), 256).alias("print"))
    seen = d.where("source = 'email'")
    return d.join(seen.select("doc_id"), "doc_id", "left_anti").join(seen.select("print").distinct(), "print", "left_anti").groupBy("source").agg(F.count("*").alias("held_out"))


def attachment_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Attachments by the media type of their name and the branch that it goes to; those that are missing, and those over a size."""
    a = table(spark, folder, "inbound_message").select(F.explode("attachments").alias("a"))
    mime = t.media_type(F.col("a.filename"))
    return a.groupBy(mime.alias("mime"), t.media_branch(mime).alias("branch")).agg(F.count("*").alias("n"), F.count_if("a.missing").alias("missing"), F.count_if(F.coalesce(F.length("a.data"), F.lit(0)) > 10_000_000).alias("too_large"))


def chat_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of chat exports: header or continuation, sender and day order, counted by document."""
    from caseloom.sources.chat import parse_lines

    d = table(spark, folder, "documents").where("source = 'chat_export'").select("doc_id", "text")
    m = parse_lines(d, "doc_id", "text")
    return m.groupBy("doc_id").agg(F.count("*").alias("messages"), F.count_distinct("sender").alias("senders"), F.min("stamp").alias("first_stamp"), F.sum(F.length("body")).alias("chars"))


def day_first_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Day or month first by all unambiguous dates of each tenant's raw stamps; a tie means day first."""
    m = table(spark, folder, "inbound_message").where(F.col("sent_at").rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"))
    a = F.regexp_extract("sent_at", "^([0-9]{1,2})/([0-9]{1,2})/", 1).cast("int")
    b = F.regexp_extract("sent_at", "^([0-9]{1,2})/([0-9]{1,2})/", 2).cast("int")
    v = m.groupBy("tenant_id").agg(F.count_if((a > 12) & (b <= 12)).alias("day_first"), F.count_if((b > 12) & (a <= 12)).alias("month_first"))
    return v.withColumn("order", F.when(F.col("month_first") <= F.col("day_first"), "dmy").otherwise("mdy"))


def distinct_in_case(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct heads of each case in the order they came in, the first five."""
    a = table(spark, folder, "emergent_attribute").select("case_id", t.snake(F.col("head")).alias("head"), "attr_id")
    first = a.groupBy("case_id", "head").agg(F.min("attr_id").alias("at"))
    five = top_k(first, ["case_id"], [F.col("at")], 5, "k")
    return five.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "head"))), lambda x: x["head"]), ",").alias("heads"))


QUERIES = {f.__name__: f for f in (
    value_profile, document_profile, normal_names, grounded_values, kept_qualifiers, fault_grounding, locate_spans, case_text_parts, text_spans, sensitive_fields, card_scan, masked_texts, redacted_values,
    near_duplicates, boilerplate_strip, length_band, greedy_caps, held_out, attachment_routing, chat_lines, day_first_vote, distinct_in_case,
)}

_S = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"
_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_FW = "[" + ", ".join(repr(w) for w in t.FUNCTION_WORDS) + "]"
_STOP = "[" + ", ".join(repr(w) for w in t.STOPWORDS) + "]"
_PRINT = "trim((lower(regexp_replace(regexp_replace({}, 'XX+|[0-9]+', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))))"


def _grounded_sql(v: str, s: str) -> str:
    low, long = f"lower(trim({v}))", f"list_filter({_TOK.format(v)}, lambda x: length(x) > 2)"
    return f"""CASE WHEN {low} = '' THEN false WHEN contains(lower({s}), {low}) THEN true WHEN len({long}) = 0 THEN len(list_filter({_TOK.format(v)}, lambda x: contains(lower({s}), x))) > 0
        ELSE len(list_filter({long}, lambda x: contains(lower({s}), x))) / len({long}) >= 0.6 END"""


def _words_sql(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)))"


_STATE = " OR ".join(f"starts_with(lower(trim({{0}})), {s.replace(chr(39), chr(39) * 2)!r})" if "'" not in s else f"starts_with(lower(trim({{0}})), '{s.replace(chr(39), chr(39) * 2)}')" for s in t.STATE_OPENINGS)
_FIRST = "string_split(text, '.')[1]"
_MIME = "CASE " + " ".join(f"WHEN e = '{k}' THEN '{v}'" for k, v in t.MEDIA_TYPES.items()) + " ELSE 'application/octet-stream' END"
SQL = {
    "value_profile": f"""
        SELECT {kind_sql('value')} AS kind, count(*) AS n, round(avg(CASE WHEN len({_TOK.format('value')}) = 0 THEN 0.0 ELSE len(list_filter({_TOK.format('value')}, lambda x: list_contains({_FW}, x))) / len({_TOK.format('value')}) END), 6) AS mean_ratio
        FROM emergent_attribute GROUP BY 1""",
    "document_profile": f"WITH d AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT lang, {kind_sql('line')} AS kind, count(*) AS n FROM d GROUP BY 1, 2",
    "normal_names": f"""
        WITH p AS (SELECT p_partkey, {_S.format('p_type')} AS head, {_S.format('p_brand')} AS brand FROM part),
        n AS (SELECT p_partkey, head, brand, CASE WHEN brand <> '' AND brand <> head THEN brand || '_' || head ELSE head END AS name FROM p)
        SELECT p_partkey, name, CASE WHEN name <> head AND ends_with(name, '_' || head) THEN nullif(substr(name, 1, length(name) - length(head) - 1), '') END AS qualifier,
               list_filter(string_split(head, '_'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+(st|nd|rd|th)?$'))[-1] AS noun FROM n""",
    "grounded_values": f"""
        WITH c AS (SELECT concat_ws(' ', product, gold_category, gold_desired_outcome, gold_severity_signal, gold_emotion_signal, gold_key_facts) AS source, unnest(string_split(gold_key_facts, ';')) AS item FROM cfpb_labels WHERE gold_key_facts IS NOT NULL),
        i AS (SELECT source, trim(string_split(item, '=')[1]) AS name, trim(string_split(item, '=')[-1]) AS value FROM c)
        SELECT name, count(*) AS n, count(*) FILTER ({_grounded_sql('value', 'source')}) AS grounded,
               count(*) FILTER ({_S.format('name')} <> '' AND contains(array_to_string({_TOK.format('source')}, ' '), replace({_S.format('name')}, '_', ' '))) AS extractive
        FROM i WHERE value <> '' GROUP BY 1""",
    "kept_qualifiers": f"""
        WITH a AS (SELECT {_S.format('qualifier')} AS q, concat_ws(' ', head, value, qualifier) AS source FROM emergent_attribute)
        SELECT CASE WHEN q <> '' AND len(string_split(q, '_')) <= 4 AND contains(array_to_string({_TOK.format('source')}, ' '), replace(q, '_', ' ')) THEN q END AS qualifier, count(*) AS n FROM a GROUP BY 1""",
    "fault_grounding": f"""
        WITH d AS (SELECT doc_id, lang, text, {_FIRST} AS fault FROM documents)
        SELECT doc_id, lang, coalesce(NOT ({_STATE.format('fault')}) AND len({_words_sql('fault')}) > 0 AND len(list_intersect({_words_sql('fault')}, {_words_sql('text')})) / len({_words_sql('fault')}) >= 0.4, false) AS grounded, len({_words_sql('fault')}) AS words FROM d""",
    "locate_spans": """
        WITH d AS (SELECT case_id, doc_id, lower(text) AS low, coalesce(sum(length(text) + 1) OVER (PARTITION BY case_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM documents WHERE case_id IS NOT NULL),
        v AS (SELECT DISTINCT case_id, trim(value) AS value FROM emergent_attribute WHERE trim(value) <> ''),
        h AS (SELECT v.case_id, v.value, d.doc_id, base + instr(low, lower(v.value)) - 1 AS char_start FROM v JOIN d ON v.case_id = d.case_id WHERE instr(low, lower(v.value)) > 0)
        SELECT case_id, value, doc_id, char_start, char_start + length(value) AS char_end FROM h QUALIFY row_number() OVER (PARTITION BY case_id, value ORDER BY doc_id) = 1""",
    "case_text_parts": """
        WITH n AS (SELECT case_id, text, row_number() OVER (PARTITION BY case_id ORDER BY doc_id) AS n FROM documents WHERE case_id IS NOT NULL AND text <> ''),
        p AS (SELECT case_id, (n - 1) // 50 AS part_no, count(*) AS documents, string_agg(text, chr(10) ORDER BY n) AS text FROM n GROUP BY 1, 2)
        SELECT case_id, part_no, documents, length(text) AS length, sha256(text) AS sha FROM p""",
    "text_spans": """
        SELECT 'text' AS kind, message_id AS id, 1::BIGINT AS spans, length(text)::DOUBLE AS reach FROM inbound_message WHERE text IS NOT NULL
        UNION ALL SELECT 'audio', transcript_id, len(segments)::BIGINT, list_max(list_transform(segments, lambda x: x.t_end)) FROM transcript""",
    "sensitive_fields": f"""
        WITH w AS (SELECT {_S.format('head')} AS name, value FROM emergent_attribute UNION ALL SELECT {_S.format('qualifier')}, value FROM emergent_attribute)
        SELECT coalesce({sensitive_sql('name')}, CASE WHEN regexp_matches(value, '(^|[^0-9A-Za-z_])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}([^0-9A-Za-z_]|$)') THEN 'government_id' END, 'none') AS category, count(*) AS n FROM w WHERE name <> '' GROUP BY 1""",
    "card_scan": """
        WITH f AS (SELECT text FROM inbound_message UNION ALL SELECT gold_key_facts FROM cfpb_labels),
        r AS (SELECT text, list_transform(regexp_extract_all(text, '[0-9](?:[ -]?[0-9]){12,18}'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS runs FROM f WHERE text IS NOT NULL),
        s AS (SELECT text, runs, list_filter(runs, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (x[-i]::INT * 2) // 10 + (x[-i]::INT * 2) % 10 ELSE x[-i]::INT END)) % 10 = 0) AS cards FROM r)
        SELECT count(*) AS texts, count(*) FILTER (len(runs) > 0) AS with_runs, sum(len(cards))::BIGINT AS cards FROM s""",
    "masked_texts": """
        SELECT id, regexp_replace(regexp_replace(gold_key_facts, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}', '«redacted:email»', 'g'), '\\+?[0-9][0-9 \\t\\n\\-().]{5,}[0-9]', '«redacted:digits»', 'g') AS facts FROM cfpb_labels""",
    "redacted_values": "SELECT head, count(*) FILTER (regexp_matches(regexp_replace(lower(regexp_replace(value, '[0-9]', 'X', 'g')), '[^a-z0-9]+', '', 'g'), '^x*$')) AS redacted, count(*) AS n FROM emergent_attribute GROUP BY 1",
    "near_duplicates": f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {_PRINT.format('text')}",
    "boilerplate_strip": """
        WITH d AS (SELECT doc_id, trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(lower(x), 'scanned by |cam[ \\t]?scanner|created with')), chr(10))) AS m FROM documents WHERE source = 'scanned_letter')
        SELECT doc_id, length(m) AS length, length(m) >= 40 AS digital FROM d""",
    "length_band": "SELECT source, count(*) FILTER (length(text) BETWEEN 120 AND 1400) AS band_a, count(*) FILTER (length(text) BETWEEN 180 AND 1400) AS band_b FROM documents GROUP BY 1",
    "greedy_caps": """
        WITH two AS (SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) <= 2)
        SELECT doc_id, lang, source FROM two QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 9""",
    "held_out": f"""
        WITH d AS (SELECT doc_id, source, {_PRINT.format('text')} AS print FROM documents)
        SELECT source, count(*) AS held_out FROM d WHERE source <> 'email' AND print NOT IN (SELECT print FROM d WHERE source = 'email') GROUP BY 1""",
    "attachment_routing": f"""
        WITH a AS (SELECT unnest(attachments) AS a FROM inbound_message), e AS (SELECT a, CASE WHEN contains(a.filename, '.') THEN lower(string_split(a.filename, '.')[-1]) ELSE '' END AS e FROM a), m AS (SELECT a, {_MIME} AS mime FROM e)
        SELECT mime, CASE WHEN mime LIKE 'text/%' THEN 'text' WHEN mime LIKE 'audio/%' THEN 'audio' WHEN mime LIKE 'image/%' THEN 'image' WHEN mime = 'application/pdf' THEN 'pdf' ELSE 'none' END AS branch,
               count(*) AS n, count(*) FILTER (a.missing) AS missing, count(*) FILTER (coalesce(octet_length(a.data), 0) > 10000000) AS too_large FROM m GROUP BY 1, 2""",
    "day_first_vote": """
        WITH m AS (SELECT tenant_id, regexp_extract(sent_at, '^([0-9]{1,2})/([0-9]{1,2})/', 1)::INT AS a, regexp_extract(sent_at, '^([0-9]{1,2})/([0-9]{1,2})/', 2)::INT AS b FROM inbound_message WHERE regexp_matches(sent_at, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}')),
        v AS (SELECT tenant_id, count(*) FILTER (a > 12 AND b <= 12) AS day_first, count(*) FILTER (b > 12 AND a <= 12) AS month_first FROM m GROUP BY 1)
        SELECT *, CASE WHEN month_first <= day_first THEN 'dmy' ELSE 'mdy' END AS "order" FROM v""",
    "distinct_in_case": f"""
        WITH f AS (SELECT case_id, {_S.format('head')} AS head, min(attr_id) AS seen FROM emergent_attribute GROUP BY 1, 2),
        k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY seen) <= 5)
        SELECT case_id, string_agg(head, ',' ORDER BY seen) AS heads FROM k GROUP BY 1""",
    "chat_lines": """
        WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS raw FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE source = 'chat_export')),
        c AS (SELECT doc_id, i, trim(replace(replace(translate(raw, '‎‏‪‫‬⁦⁧⁨⁩', ''), ' ', ' '), ' ', ' ')) AS line FROM l),
        h AS (SELECT *, regexp_extract(line, '^\\[?([0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4},? +[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?( *[APap][Mm])?)(\\] +| +- +)', 1) AS stamp,
                     regexp_replace(line, '^\\[?[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4},? +[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?( *[APap][Mm])?(\\] +| +- +)', '') AS rest FROM c),
        m AS (SELECT *, sum(CASE WHEN stamp <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS msg FROM h),
        g AS (SELECT doc_id, msg, arg_min(stamp, i) AS stamp, arg_min(rest, i) AS head, string_agg(CASE WHEN stamp = '' THEN chr(10) || line ELSE '' END, '' ORDER BY i) AS more FROM m WHERE msg > 0 GROUP BY 1, 2),
        s AS (SELECT doc_id, stamp, string_split(head, ': ')[1] AS sender, trim(substr(head, instr(head, ': ') + 2) || more, ' ' || chr(10)) AS body FROM g WHERE contains(head, ': ') AND length(string_split(head, ': ')[1]) <= 80)
        SELECT doc_id, count(*) AS messages, count(DISTINCT sender) AS senders, min(stamp) AS first_stamp, sum(length(body))::BIGINT AS chars FROM s GROUP BY 1""",
}
