"""Chat exports: lines with two dialects of headers, continued bodies and attachment marks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import media_type, without_marks

#: A stamp with its brackets or dash, at the start of a line.
HEADER = r"^\[?([0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4},? +[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?( *[APap][Mm])?)(\] +| +- +)"
# Marks of an attachment, present or left out.
ATTACHED = r"(?i)^(?:<attached: *(.+?)>|(.+?) *\((?:file attached|ملف مرفق)\)) *$"
OMITTED = r"(?i)^(?:<media omitted>|<وسائط مستبعدة>|image omitted|audio omitted)"
FORMATS = ("d/M/y, H:mm:ss", "d/M/y, H:mm", "d/M/y, h:mm:ss a", "d/M/y, h:mm a")


def parse_lines(exports: DataFrame, key: str, text: str) -> DataFrame:
    """Messages (key, line_no, stamp, sender, body) of exported chats.

    A line without a header continues the message above; lines before the first
    header and messages without a sender (system lines) are dropped. The first
    ``": "`` ends the sender, who has 80 characters at most. Everything of one
    export stays in its row, so there is no exchange; null and empty exports have
    no messages.
    """
    lines = F.transform(F.split(F.col(text), "\n"), without_marks)
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("no"), F.regexp_extract(x, HEADER, 1).alias("stamp"), x.alias("line"), F.regexp_replace(x, HEADER, "").alias("rest")))
    split = exports.select(F.col(key), numbered.alias("_lines")).select(key, "_lines", F.filter("_lines", lambda x: x["stamp"] != "").alias("_heads"))

    def message(x: Column, k: Column) -> Column:  # a header's body goes up to the next header
        after = F.coalesce(F.get("_heads", k + 1)["no"], F.size("_lines") + 1)
        more = F.transform(F.slice("_lines", x["no"] + 1, after - x["no"] - 1), lambda y: y["line"])
        return F.struct(x["no"].alias("no"), x["stamp"].alias("stamp"), x["rest"].alias("head"), more.alias("more"))

    messages = split.select(F.col(key), F.explode(F.transform("_heads", message)).alias("m"))
    at = F.instr(F.col("m.head"), ": ")
    body = F.btrim(F.array_join(F.concat(F.array(F.col("m.head").substr(at + 2, F.length("m.head"))), F.col("m.more")), "\n"), F.lit(" \n"))
    out = messages.select(key, F.col("m.no").alias("line_no"), F.col("m.stamp").alias("stamp"), F.substring_index("m.head", ": ", 1).alias("sender"), body.alias("body"), at.alias("_at"))
    return out.where((F.col("_at") > 0) & (F.length("sender") <= 80)).drop("_at")


def with_attachment(messages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Messages with ``attachment`` (filename, mime, missing) by the mark in the first line; what follows the mark is the caption. ``files`` (key, filename) tells which are there."""
    first = F.substring_index("body", "\n", 1)
    name = F.nullif(F.concat(F.regexp_extract(first, ATTACHED, 1), F.regexp_extract(first, ATTACHED, 2)), F.lit(""))
    omitted = first.rlike(OMITTED)
    caption = F.nullif(F.btrim(F.col("body").substr(F.length(first) + 1, F.length("body")), F.lit(" \n")), F.lit(""))
    out = messages.withColumn("filename", F.when(omitted, "<omitted>").otherwise(name)).withColumn("body", F.when(omitted | name.isNotNull(), caption).otherwise(F.col("body")))
    if files is not None:
        known = files.select("filename").distinct().withColumn("_there", F.lit(True))
        out = out.join(known, "filename", "left")
    else:
        out = out.withColumn("_there", F.lit(None).cast("boolean"))
    there = F.coalesce("_there", F.lit(False))
    return out.withColumn("attachment", F.when(F.col("filename").isNotNull(), F.struct("filename", media_type(F.col("filename")).alias("mime"), (~there).alias("missing")))).drop("filename", "_there")


def unzip(spark: SparkSession, path: str) -> DataFrame:
    """Exports of ZIP files: (path, transcript, files), ``files`` having (filename, length, data).

    The transcript is ``_chat.txt``, else the shortest-named text file. Of files of
    one name that beside the transcript wins, else the first. A damaged archive
    or one without text gives a null transcript.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                text, files = None, {}
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if not n.endswith("/")]
                        texts = [n for n in names if n.lower().endswith(".txt")]
                        chosen = next((n for n in texts if n.lower().endswith("_chat.txt")), min(texts, key=len, default=None))
                        if chosen:
                            text = z.read(chosen).decode("utf-8", "replace")
                            home = chosen.rpartition("/")[0]
                            for n in names:
                                folder, _, base = n.rpartition("/")
                                if n != chosen and (base not in files or folder == home):
                                    files[base] = z.read(n)
                except zipfile.BadZipFile:
                    pass
                rows.append((p, text, [{"filename": k, "length": len(v), "data": v} for k, v in files.items()]))
            yield pd.DataFrame(rows, columns=["path", "transcript", "files"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "path string, transcript string, files array<struct<filename:string,length:long,data:binary>>")


def parsed_stamps(messages: DataFrame, key: str) -> DataFrame:
    """Messages with ``sent_at`` under one date order for each export, voted by all its stamps; a tie means day first. A stamp that fits no format gives null."""
    plain = F.upper(F.regexp_replace(F.regexp_replace("stamp", "[.-]", "/"), " +", " "))
    plain = F.regexp_replace(F.regexp_replace(plain, "([0-9])([AP]M)$", "$1 $2"), "^([0-9/]+) ", "$1, ")
    m = messages.withColumn("_s", plain)
    a, b = (F.regexp_extract("_s", "^([0-9]{1,4})/([0-9]{1,2})/", i).cast("int") for i in (1, 2))
    votes = m.groupBy(key).agg(F.count_if((b > 12) & (a <= 12)).alias("_mf"), F.count_if((a > 12) & (b <= 12)).alias("_df"))
    m = m.join(votes, key)
    swapped = F.regexp_replace("_s", "^([0-9]{1,2})/([0-9]{1,2})/", "$2/$1/")
    day_first = F.when(F.col("_mf") > F.col("_df"), swapped).otherwise(F.col("_s"))
    full = F.regexp_replace(day_first, "^([0-9]{1,2}/[0-9]{1,2})/([0-9]{2}),", "$1/20$2,")
    return m.withColumn("sent_at", F.coalesce(*[F.try_to_timestamp(full, F.lit(f)) for f in FORMATS])).drop("_s", "_mf", "_df")
