"""Zone transition tables and the vectorised conversion of wall-clock time."""

from __future__ import annotations

import datetime as dt
import zoneinfo
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np

_FIRST, _LAST = dt.datetime(1970, 1, 1, tzinfo=dt.UTC), dt.datetime(2100, 1, 1, tzinfo=dt.UTC)

# Abbreviations in use for zones whose database entry has only a
# numeric name, as offsets in seconds.
LOCAL_ABBREVIATIONS = {
    "Asia/Dubai": {"GST": 14400},
    "Asia/Riyadh": {"AST": 10800},
    "Asia/Karachi": {"PKT": 18000, "PKST": 21600},
    "Asia/Kolkata": {"IST": 19800},
    "America/Sao_Paulo": {"BRT": -10800, "BRST": -7200},
}
UNIVERSAL = {"UTC": 0, "GMT": 0, "Z": 0, "UT": 0}


@lru_cache(maxsize=1)
def database_version() -> str:
    """Version of the zone database that this process reads."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION", "version"):
            p = Path(folder, name)
            if p.exists():
                with p.open(errors="replace") as f:
                    return f.readline().strip().removeprefix("# version ")
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@dataclass(frozen=True)
class ZoneTable:
    """Transitions of a zone: ``offsets[i]`` holds before ``at[i]`` and ``offsets[-1]`` after the last."""

    version: str
    at: np.ndarray
    offsets: np.ndarray
    local: np.ndarray
    names: dict[str, int]

    def to_utc(self, wall: np.ndarray) -> np.ndarray:
        """UTC seconds of wall-clock seconds. A time that occurs twice means the earlier instant, a skipped one moves forward by the gap: both keep the offset before the transition."""
        return wall - self.offsets[np.searchsorted(self.local, wall, side="right")]

    def to_wall(self, utc: np.ndarray) -> np.ndarray:
        """Wall-clock seconds of UTC seconds."""
        return utc + self.offsets[np.searchsorted(self.at, utc, side="right")]


@lru_cache(maxsize=2048)
def zone_table(name: str) -> ZoneTable | None:
    """Table of a zone from 1970 to 2100, or None for an unknown name."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None
    state = lambda t: (zone.utcoffset(t.astimezone(zone)), zone.tzname(t.astimezone(zone)))
    at, offsets, names = [], [], {}
    t, now = _FIRST, state(_FIRST)
    offsets.append(int(now[0].total_seconds()))
    names[now[1]] = offsets[0]
    week = dt.timedelta(days=7)
    while t < _LAST:
        nxt = t + week
        then = state(nxt)
        if then != now:
            lo, hi = t, nxt
            while hi - lo > dt.timedelta(seconds=1):
                mid = lo + (hi - lo) // 2
                mid = mid.replace(microsecond=0)
                if mid <= lo:
                    break
                lo, hi = (mid, hi) if state(mid) == now else (lo, mid)
            if then[0] != now[0]:
                at.append(int(hi.timestamp()))
                offsets.append(int(then[0].total_seconds()))
            names[then[1]] = int(then[0].total_seconds())
            now = then
        t = nxt
    names |= LOCAL_ABBREVIATIONS.get(name, {})
    a, o = np.array(at, np.int64), np.array(offsets, np.int64)
    return ZoneTable(database_version(), a, o, a + np.maximum(o[:-1], o[1:]), names)
