"""Written moments against a parser that reads one value at a time."""

import datetime as dt
import random
import zoneinfo

import pandas as pd
import pytest

from caseloom.functions import instants
from caseloom.functions.zones import zone_table
from caseloom.operators.timestamps import normalise_moments

ZONES = ["Europe/London", "America/New_York", "Asia/Dubai", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kolkata", "Africa/Casablanca"]


def us(t):
    return round((t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))


def one(value, zone="Europe/London", order="dmy", anchor=None):
    s = lambda x, t=object: pd.Series([x], dtype=t)
    out = instants.parse(s(value), s(zone), s(order), None if anchor is None else pd.Series([anchor], dtype="Int64"))
    return None if pd.isna(out[0]) else int(out[0])


def brute(wall, zone):
    """The earlier of two instants; a skipped time keeps the offset before the gap."""
    z = zoneinfo.ZoneInfo(zone)
    return us(wall.replace(tzinfo=z, fold=0).astimezone(dt.UTC))


@pytest.mark.parametrize("zone", ZONES)
def test_wall_clock_matches_the_standard_library(zone):
    rng = random.Random(zone)
    table = zone_table(zone)
    walls = [dt.datetime(2000, 1, 1) + dt.timedelta(seconds=rng.randrange(40 * 365 * 86_400)) for _ in range(800)]
    for at, off in zip(table.at[-60:], table.offsets[-61:]):  # around transitions
        base = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(at + off))
        walls += [base + dt.timedelta(minutes=m) for m in (-61, -31, -1, 0, 1, 29, 30, 59, 60, 61)]
    got = table.to_utc(pd.Series([int((w - dt.datetime(1970, 1, 1)).total_seconds()) for w in walls]).to_numpy())
    assert [g * 1_000_000 for g in got] == [brute(w, zone) for w in walls]


CASES = [
    ("2025-01-26T16:27:29Z", "2025-01-26T16:27:29+00:00"), ("2025-07-11T00:39:41.567Z", "2025-07-11T00:39:41.567+00:00"), ("20250309T062450Z", "2025-03-09T06:24:50+00:00"),
    ("2025-08-22 05:13:58", "2025-08-22T04:13:58+00:00"), ("1743377281916", "2025-03-30T23:28:01.916+00:00"), ("1736235551", "2025-01-07T07:39:11+00:00"), ("1759069024338351", "2025-09-28T14:17:04.338351+00:00"),
    ("19/12/2025, 8:06:51 AM", "2025-12-19T08:06:51+00:00"), ("24/4/26, 12:10 AM", "2026-04-23T23:10:00+00:00"), ("١٣/١١/٢٠٢٥، ٤:٣٦ ص", "2025-11-13T04:36:00+00:00"), ("٢٤/٢/٢٠٢٦، ١١:٠٥ م", "2026-02-24T23:05:00+00:00"),
    ("Sat, 02 Aug 2025 11:22:54 +0100", "2025-08-02T10:22:54+00:00"), ("Fri 24 Jan 2025 8pm", "2025-01-24T20:00:00+00:00"), ("Thu 18 Sep 2025 3.30pm", "2025-09-18T14:30:00+00:00"), ("Mar 9, 2025 3:53 AM", "2025-03-09T03:53:00+00:00"),
    ("2025-06-04T15:16:02[America/New_York]", "2025-06-04T19:16:02+00:00"), ("2025-10-26 01:30:00 GMT", "2025-10-26T01:30:00+00:00"), ("2025-10-26 01:30:00 BST", "2025-10-26T00:30:00+00:00"),
    ("2025-10-26 01:30", "2025-10-26T00:30:00+00:00"), ("2025-03-30 01:30", "2025-03-30T01:30:00+00:00"), ("2025-07-11 11:00+01", "2025-07-11T10:00:00+00:00"), ("‎21/07/2025, 21:59 ", "2025-07-21T20:59:00+00:00"),
]


@pytest.mark.parametrize("value,expected", CASES)
def test_formats(value, expected):
    assert one(value) == us(dt.datetime.fromisoformat(expected))


@pytest.mark.parametrize("value", ["", " ", "asap", "0000-00-00", "2025-02-30 10:00", "31/31/2025, 10:00", "25:10", "2025-01-01 24:01", "n/a", "13:00 PM", "🎂", "2025-06-04T15:16:02[Nowhere/Land]", "x" * 100_000, "9" * 50_000])
def test_values_that_name_no_moment(value):
    assert one(value) is None


def test_order_zone_and_bare_times():
    assert one("05/08/2026, 3:21:07 PM", "America/New_York", "mdy") == us(dt.datetime(2026, 5, 8, 19, 21, 7, tzinfo=dt.UTC))
    assert one("2025-01-01 10:00", None) is None and one("2025-01-01T10:00:00Z", None) is not None
    assert one("01/02/2025, 10:00", order=None) is None
    anchor = us(dt.datetime(2025, 8, 28, 22, 30, tzinfo=dt.UTC))  # the 29th in Berlin
    assert one("7.18pm", "Europe/Berlin", anchor=anchor) == us(dt.datetime(2025, 8, 29, 17, 18, tzinfo=dt.UTC))
    assert one("7.18pm", "Europe/Berlin") is None


def test_operator_edges(spark):
    tenants = spark.createDataFrame([(1, "Europe/London", "dmy"), (1, "Europe/London", "dmy"), (None, "Asia/Dubai", "dmy")], "tenant_id long, time_zone string, date_order string")
    rows = spark.createDataFrame([(1, 1, "2025-01-01 10:00", "x"), (1, 1, "2025-01-01 10:00", "x"), (2, 9, "2025-01-01 10:00", None), (3, None, "2025-01-01T10:00:00Z", None), (4, 1, None, None), (5, 1, "", None)], "id long, tenant_id long, at string, time_zone string")
    out = sorted((r.row_id, r.utc_us) for r in normalise_moments(rows, tenants, "id", {"at": None}).collect() if r.utc_us is not None)
    t = us(dt.datetime(2025, 1, 1, 10, tzinfo=dt.UTC))
    assert out == [(1, t), (1, t), (3, t)]
    assert normalise_moments(rows.limit(0), tenants.limit(0), "id", {"at": None}).count() == 0
