"""Decisions on every event."""

import datetime as dt

from caseloom.queries import registry


def test_every_event_is_decided_against_the_one_before(spark, tmp_path):
    at = lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, at(0), 1, "view"), (2, at(1), 1, "error"), (3, at(2), 1, "view"), (4, at(30), 1, "error"), (5, at(200), 1, "view"), (6, at(200), 2, "view"), (7, at(230), 1, "view"), (8, at(200), 2, "view"), (9, None, 2, "view")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.decision for r in registry.QUERIES["event_decisions"](spark, str(tmp_path)).collect()}
    assert got == {1: "new_no_prior", 2: "follow_up", 3: "classify_terminal", 4: "classify_idle", 5: "new_terminal", 6: "new_no_prior", 7: "classify_idle", 8: "follow_up"}
