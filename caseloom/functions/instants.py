"""Parsing of written moments by shape.

A value is turned into a mask with one character class per character. Each
distinct mask is matched once against the layouts below; the match gives the
positions of the fields, so all values of a mask are read as digit columns of
one character matrix, without a loop over rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd

from caseloom.functions.zones import UNIVERSAL, zone_table

_OTHER_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९"
_CLEAN = {ord(c): str(i % 10) for i, c in enumerate(_OTHER_DIGITS)} | {ord(c): None for c in "‎‏‪‫‬‭‮⁦⁧⁨⁩﻿"} | {ord(c): " " for c in "   \t"} | {ord("،"): ","}
_MASK = {ord(c): "9" for c in "0123456789"} | {ord(c): "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"} | {ord("ص"): "B", ord("م"): "B"}

# English month names by their first three letters.
_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}

_CLOCK = r"(?P<H>99?)(?::(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?)"
_HALF = r"(?P<H>99?)(?:[:.](?P<M>99)(?::(?P<S>99))?)? ?(?P<p>AA|B)"
_ZONE = r"(?: ?(?P<o>[+\-]99(?::?99)?)|\[(?P<z>[A/_+\-9]+)\]| (?P<a>A{2,5})|(?P<u>A))?"
_ISO = r"(?P<Y>9999)-(?P<m>99)-(?P<d>99)"
_NUM = r"(?P<x>99?)/(?P<y>99?)/(?P<Y>9999|99)"
_DAYNAME = r"(?:A{3,9},? )?"
#: Layouts over masks, tried in this order.
LAYOUTS = [
    re.compile(p)
    for p in (
        rf"{_ISO}(?P<t>[A ]){_CLOCK}{_ZONE}",
        r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<t>A)(?P<H>99)(?P<M>99)(?P<S>99)" + _ZONE,
        rf"{_NUM},? {_HALF}",
        rf"{_NUM},? {_CLOCK}",
        rf"(?P<d>99?)\.(?P<m>99?)\.(?P<Y>9999),? {_CLOCK}",
        rf"{_DAYNAME}(?P<d>99?) (?P<b>A{{3,9}}) (?P<Y>9999),? {_HALF}",
        rf"{_DAYNAME}(?P<d>99?) (?P<b>A{{3,9}}) (?P<Y>9999),? {_CLOCK}{_ZONE}",
        rf"{_DAYNAME}(?P<b>A{{3,9}}) (?P<d>99?), (?P<Y>9999),? {_HALF}",
        rf"{_DAYNAME}(?P<b>A{{3,9}}) (?P<d>99?), (?P<Y>9999),? {_CLOCK}{_ZONE}",
        r"(?P<e>9{10}|9{13}|9{16})",
        rf"{_HALF}",
        rf"{_CLOCK}",
    )
]


def clean(value: str) -> str:
    """The value with ASCII digits and plain spaces, without direction marks."""
    return value.translate(_CLEAN).strip()


def mask(cleaned: str) -> str:
    """Character classes of a cleaned value: 9 digit, A letter, B half-day letter; all else stays."""
    return cleaned.translate(_MASK)


@lru_cache(maxsize=65_536)
def parser(shape: str) -> dict[str, tuple[int, int]] | None:
    """Positions of the fields in values of a mask, or None if it names no moment. The cache is only a speed-up: a mask that fell out is matched again."""
    if "9" not in shape:
        return None
    for layout in LAYOUTS:
        if m := layout.fullmatch(shape):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of civil dates."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719_468


def parse(values: pd.Series, zones: pd.Series, orders: pd.Series, anchors: pd.Series | None = None) -> pd.Series:
    """UTC microseconds of written moments, null where a value names none.

    ``zones`` and ``orders`` give each row's zone name and date order (``dmy`` or
    ``mdy``); ``anchors`` the UTC microseconds whose local date a bare time of day
    falls on. Wall-clock values of rows without a known zone, and bare times
    without an anchor, give null, as do impossible dates and times.
    """
    out = pd.Series(pd.array([pd.NA] * len(values), dtype="Int64"), index=values.index)
    text = values.where(values.notna(), "").map(clean)
    shape = text.map(mask)
    for form, rows in shape.groupby(shape, sort=False).groups.items():
        fields = parser(form)
        if fields is None or not form:
            continue
        utc, ok = _read(text.loc[rows], fields, zones.loc[rows], orders.loc[rows], None if anchors is None else anchors.loc[rows])
        out.loc[rows] = pd.array(np.where(ok, utc, 0), dtype="Int64")
        out.loc[rows[~ok]] = pd.NA
    return out


def _read(text: pd.Series, f: dict[str, tuple[int, int]], zones: pd.Series, orders: pd.Series, anchors: pd.Series | None) -> tuple[np.ndarray, np.ndarray]:
    raw = text.to_numpy(dtype=str)
    n = len(raw)
    chars = np.ascontiguousarray(raw).view(np.uint32).reshape(n, -1).astype(np.int64)
    num = lambda k: sum((chars[:, i] - 48) * 10 ** (f[k][1] - 1 - i) for i in range(*f[k]))
    word = lambda k: pd.Series([s[slice(*f[k])] for s in raw])
    zero, ok = np.zeros(n, np.int64), np.ones(n, bool)
    if "e" in f:
        return num("e") * {10: 1_000_000, 13: 1000, 16: 1}[f["e"][1] - f["e"][0]], ok
    if "t" in f:
        ok &= np.isin(chars[:, f["t"][0]], [ord(c) for c in "Tt "])
    hour, minute, second = (num(k) if k in f else zero for k in "HMS")
    micro = zero
    if "f" in f:
        a, b = f["f"]
        micro = sum((chars[:, i] - 48) * 10 ** (5 - (i - a)) for i in range(a, min(b, a + 6)))
    if "p" in f:
        half = word("p").str.upper()
        late = half.isin(["PM", "م"]).to_numpy()
        ok &= (late | half.isin(["AM", "ص"]).to_numpy()) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * late
    ok &= (hour < 24) & (minute < 60) & (second < 60)
    clock = hour * 3600 + minute * 60 + second
    names = zones.where(zones.notna(), "").to_numpy()
    if "Y" in f or "y" in f:
        year = num("Y")
        year = np.where(f["Y"][1] - f["Y"][0] == 2, 2000 + year, year)
        if "x" in f:
            x, y = num("x"), num("y")
            first = (orders == "mdy").to_numpy()
            ok &= first | (orders == "dmy").to_numpy()
            month, day = np.where(first, x, y), np.where(first, y, x)
        else:
            day = num("d")
            month = word("b").str.lower().str[:3].map(_MONTHS).fillna(0).to_numpy(np.int64) if "b" in f else num("m")
        ok &= (month >= 1) & (month <= 12) & (day >= 1) & (year >= 1)
        month = np.where(ok, month, 1)
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        ok &= day <= np.where(month == 2, 28 + leap, 30 + (month + month // 8) % 2)
        wall = _days(np.where(ok, year, 1970), month, np.where(ok, day, 1)) * 86_400 + clock
    else:
        if anchors is None:
            return zero, np.zeros(n, bool)
        ok &= anchors.notna().to_numpy()
        seconds = anchors.fillna(0).to_numpy(np.int64) // 1_000_000
        wall = zero.copy()
        for name in np.unique(names):
            at = names == name
            table = zone_table(name) if name else None
            if table is not None:
                wall[at] = table.to_wall(seconds[at]) // 86_400 * 86_400 + clock[at]
    if "o" in f:
        a, b = f["o"]
        digits = [i for i in range(a + 1, b) if chars[0, i] != ord(":")]
        v = [chars[:, i] - 48 for i in digits]
        hours, minutes = v[0] * 10 + v[1], v[2] * 10 + v[3] if len(v) == 4 else zero
        sign = np.where(chars[:, a] == ord("-"), -1, 1)
        ok &= (hours <= 18) & (minutes < 60)
        return (wall - sign * (hours * 3600 + minutes * 60)) * 1_000_000 + micro, ok
    if "u" in f:
        ok &= np.isin(chars[:, f["u"][0]], [ord("Z"), ord("z")])
        return wall * 1_000_000 + micro, ok
    if "z" in f:
        names = word("z").to_numpy()
    utc = zero.copy()
    abbreviations = word("a").str.upper().to_numpy() if "a" in f else None
    for name in np.unique(names):
        at = names == name
        table = zone_table(name) if name else None
        if abbreviations is not None:
            known = UNIVERSAL | (table.names if table else {})
            offset = pd.Series(abbreviations[at]).map(known)
            ok[at] &= offset.notna().to_numpy()
            utc[at] = wall[at] - offset.fillna(0).to_numpy(np.int64)
        elif table is None:
            ok[at] = False
        else:
            utc[at] = table.to_utc(wall[at])
    return utc * 1_000_000 + micro, ok
