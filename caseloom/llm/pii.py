"""Personal details in free text: tagging, exact checks and placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.pii_tagger import Tagger
from caseloom.plans.sizing import spread

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
_ADDRESS_OF_MAIL = re.compile(r"(?i)[\w+\-]\s?(?:@|\(at\)|\[at\]|\bat\b)\s?[\w\-]+\s?(?:\.|\[dot\]|\(dot\)|\bdot\b)\s?\w")
_WORDY = re.compile(r"[^\W_]")
_EDGE = " \t\n.,;:!?\"“”«»<>*،؟۔।/="
_TITLE = re.compile(r"(?i)^(?:mr|mrs|ms|miss|dr|sh|prof|eng|herr|frau|sra?|mme)\.? +(?=\S|$)")


def checked(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Tagged spans after exact checks: joined over gaps inside a word, widened to whole words, trimmed of edges and titles, which alone are no name; numbers need digits, addresses digits or two words, e-mail addresses a name, a sign for "at" and a host with a dot."""
    joined: list[tuple[int, int, str]] = []
    for a, b, k in spans:
        if joined and joined[-1][2] == k and a - joined[-1][1] <= 1 and not text[joined[-1][1] : a].isspace():
            joined[-1] = (joined[-1][0], b, k)
        else:
            joined.append((a, b, k))
    out: list[tuple[int, int, str]] = []
    for a, b, k in joined:
        floor = out[-1][1] if out else 0
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a >= b:
            continue
        while a > floor and _WORDY.match(text[a - 1]) and _WORDY.match(text[a]):
            a -= 1
        while b < len(text) and _WORDY.match(text[b]) and _WORDY.match(text[b - 1]):
            b += 1
        part = text[a:b]
        digits = sum(c.isdigit() for c in part)
        if k == "phone":
            while a > floor and text[a - 1] in "+(":
                a -= 1
            ok = digits >= 7
        elif k == "id_number":
            ok = digits >= 6
        elif k == "email":
            ok = bool(_ADDRESS_OF_MAIL.search(part))
        elif k == "name":
            if m := _TITLE.match(part):
                a += m.end()
            ok = digits == 0 and bool(_WORDY.search(text[a:b])) and not _TITLE.fullmatch(text[a:b] + " ")
        else:
            ok = len(part) >= 4 and (digits > 0 or len(part.split()) > 1)
        if ok:
            out.append((a, b, k))
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with placeholders in place of its spans."""
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], PLACEHOLDERS[k]]
        at = b
    return "".join([*out, text[at:]])


def personal_details(rows: DataFrame, key: str, fields: dict[str, Column], model: str | None = None) -> DataFrame:
    """One row (row_id, field_name, spans, masked) for each value that holds personal details.

    ``spans`` has (kind, start_pos, end_pos), from 1 in code points, the end
    exclusive. Values are read whole, in overlapping windows. Null and empty
    values and values without details give no row; equal values of a batch are
    read once; repeated rows are answered each; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger.load(model)
        for pdf in batches:
            codes, distinct = pd.factorize(pdf["value"])
            texts = [str(t) for t in distinct]
            found: list = []
            at = 0
            while at < len(texts):  # parts of bounded size keep the scores of long texts small
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= 150_000):
                    chars += len(texts[end])
                    end += 1
                found += [checked(t, s) for t, s in zip(texts[at:end], tagger.spans(texts[at:end]))]
                at = end
            keep = [i for i, c in enumerate(codes) if found[c]]
            if not keep:
                continue
            part = pdf.iloc[keep]
            yield pd.DataFrame({
                "row_id": part["row_id"].to_numpy(), "field_name": part["field_name"].to_numpy(),
                "spans": [[{"kind": k, "start_pos": a + 1, "end_pos": b + 1} for a, b, k in found[codes[i]]] for i in keep],
                "masked": [masked(texts[codes[i]], found[codes[i]]) for i in keep],
            })

    each = F.array(*[F.struct(F.lit(n).alias("field_name"), c.alias("value")) for n, c in fields.items()])
    values = rows.select(F.col(key).cast("long").alias("row_id"), F.inline(each)).where(F.col("row_id").isNotNull() & (F.length("value") > 0))
    return spread(values).mapInPandas(run, "row_id long, field_name string, spans array<struct<kind:string,start_pos:long,end_pos:long>>, masked string")
