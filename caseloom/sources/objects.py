"""Uploaded records without a schema: CSV, JSON and JSON lines as maps of strings."""

from __future__ import annotations

import email.parser
import email.policy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Members that may hold the list of records.
WRAPPERS = ("objects", "data", "records", "rows", "items")
_MAP, _MAPS = "map<string,string>", "array<map<string,string>>"


def _tidy(df: DataFrame) -> DataFrame:
    """Records with trimmed names and values; those without any value are dropped."""
    clean = F.map_from_entries(F.transform(F.map_entries("attributes"), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("value"))))
    return df.withColumn("attributes", clean).where(F.exists(F.map_values("attributes"), lambda v: v != ""))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header as (path, attributes)."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding="UTF-8")
    names = [c.lstrip("﻿") for c in raw.columns]
    raw = raw.toDF(*names)
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in names])) if names else F.create_map()
    return _tidy(raw.select(F.input_file_name().alias("path"), pairs.alias("attributes")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files as (path, attributes): an array, an object with a list under a usual name, or one object. A file that is no JSON fails with its path."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("t"))
    text = text.where(F.trim("t") != "")
    one = F.from_json("t", _MAP)
    listed = F.coalesce(*[F.from_json(one[w], _MAPS) for w in WRAPPERS])
    records = F.when(F.ltrim("t").startswith("["), F.from_json("t", _MAPS)).otherwise(F.coalesce(listed, F.array(one)))
    bad = F.try_parse_json("t").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no JSON: "), F.col("path")))).otherwise(F.lit(True))
    return _tidy(text.where(checked).select("path", F.explode(records).alias("attributes")).where("attributes IS NOT NULL"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of files with one JSON object a line as (path, attributes); a broken line fails with its text."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("t")).where(F.trim("t") != "")
    bad = F.try_parse_json("t").isNull() | ~F.ltrim("t").startswith("{")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no JSON object in "), F.col("path"), F.lit(": "), F.substring("t", 1, 80)))).otherwise(F.lit(True))
    return _tidy(lines.where(checked).select("path", F.from_json("t", _MAP).alias("attributes")))


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of the lines that are no JSON object, numbered from 1, for the message after a failure; a file is one row here."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("i", "t"))
    t = F.regexp_replace("t", "^\ufeff", "")
    return whole.where((F.trim(t) != "") & (F.try_parse_json(t).isNull() | ~F.ltrim(t).startswith("{"))).select("path", (F.col("i") + 1).alias("line_no"), t.alias("line"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file or folder by its ending, else by its first character; another ending than those of records is refused."""
    low = path.lower()
    ending = low.rstrip("/").rpartition("/")[2].rpartition(".")
    if ending[1] and ending[0] and ending[2] not in ("csv", "json", "jsonl", "ndjson", "txt", "parquet"):
        raise ValueError(f"no records are read from files like {path}")
    if low.endswith(".csv"):
        return read_csv(spark, path)
    if low.endswith((".jsonl", ".ndjson")):
        return read_jsonl(spark, path)
    if low.endswith(".json"):
        return read_json(spark, path)
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", "^﻿", "")), 1, 1)).first()
    head = first[0] if first else ""
    if head == "[":
        return read_json(spark, path)
    if head == "{":
        lines = spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json(F.regexp_replace("value", "^\ufeff", "")).isNotNull().alias("whole")).limit(2).collect()
        return read_jsonl(spark, path) if len(lines) > 1 and lines[0].whole else read_json(spark, path)
    if not head:
        raise ValueError(f"nothing to read in {path}")
    return read_csv(spark, path)


def webhook_messages(payloads: DataFrame, column: str) -> DataFrame:
    """Text messages (sender, text) of webhook payloads: entry, changes, messages; other kinds and broken payloads give none."""
    schema = "entry array<struct<changes:array<struct<value:struct<messages:array<struct<`from`:string,type:string,text:struct<body:string>>>>>>>>"
    doc = F.from_json(F.col(column), schema)
    m = payloads.select(F.explode(doc["entry"]).alias("e")).select(F.explode("e.changes").alias("c")).select(F.explode("c.value.messages").alias("m"))
    return m.where("m.type = 'text' AND m.text.body IS NOT NULL").select(F.col("m.from").alias("sender"), F.col("m.text.body").alias("text"))


def multipart(requests: DataFrame, key: str, content_type: str, body: str) -> DataFrame:
    """Parts (key, name, filename, mime, content) of multipart form bodies, in order; other bodies, and null ones, have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, kind, raw in zip(pdf["key"], pdf["kind"], pdf["body"]):
                if not kind or raw is None or not kind.lower().startswith("multipart/"):
                    continue
                message = email.parser.BytesParser(policy=email.policy.HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + bytes(raw))
                for part in message.iter_parts():
                    rows.append((k, part.get_param("name", header="content-disposition"), part.get_filename(), part.get_content_type(), part.get_payload(decode=True) or b""))
            if rows:
                yield pd.DataFrame(rows, columns=["key", "name", "filename", "mime", "content"])

    kind = dict(requests.dtypes)[key]
    named = requests.select(F.col(key).alias("key"), F.col(content_type).alias("kind"), F.col(body).alias("body"))
    return named.mapInPandas(read, f"key {kind}, name string, filename string, mime string, content binary").withColumnRenamed("key", key)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Dropped files as messages (path, sha256, mime, text, length): text files by their content, others as attachments."""
    from caseloom.functions.text import media_type

    files = spark.read.format("binaryFile").load(path)
    name = F.substring_index("path", "/", -1)
    mime = media_type(name)
    return files.select("path", F.sha2("content", 256).alias("sha256"), mime.alias("mime"), F.when(mime.startswith("text/"), F.decode("content", "UTF-8")).alias("text"), "length")


def synthetic_orders(spark: SparkSession, n: int, seed: int = 42, shared_percent: int = 18) -> DataFrame:
    """Seeded orders (order_id, phone, customer, shared) of which about ``shared_percent`` in a hundred share a phone; each row follows from its number alone."""
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1_000_000))
    shared = h("s") % 100 < shared_percent
    phone = F.when(shared, h("p") % max(1, n // 10)).otherwise(F.col("id") + 1_000_000)
    return spark.range(n).select(F.format_string("BK-%08d", "id").alias("order_id"), F.format_string("+9715%08d", phone).alias("phone"), F.format_string("customer %d", h("c") % max(1, n // 3)).alias("customer"), shared.alias("shared"))
