"""Windows and sessions that are still open when a stream ends are part of the result."""

import os
from datetime import datetime

import pytest

from faultline.plans.catalog import QUERIES

EVENTS = [
    (1, datetime(2024, 1, 1, 0), 7, "click"),
    (2, datetime(2024, 1, 1, 6), 7, "error"),
    (3, datetime(2024, 1, 2, 0), 7, "view"),
    (4, datetime(2024, 1, 2, 1), 8, "error"),
]


@pytest.fixture
def tables(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.createDataFrame([(*r, 1.0, "{}") for r in EVENTS], schema)
    rows.coalesce(1).write.parquet(f"{tmp_path}/part")
    (name,) = [x for x in os.listdir(f"{tmp_path}/part") if x.endswith(".parquet")]
    os.rename(f"{tmp_path}/part/{name}", f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_open_week(spark, tables):
    assert [tuple(r) for r in QUERIES["stream_tumbling"](spark, tables).collect()] == [("2023-12-28", 4, 2)]


def test_open_months(spark, tables):
    got = {r.start: (r.commits, r.fixes) for r in QUERIES["stream_sliding"](spark, tables).collect()}
    assert len(got) == 31
    assert got["2023-12-03"] == (2, 1) and got["2023-12-04"] == (4, 2) and got["2024-01-02"] == (2, 1)


def test_open_sessions(spark, tables):
    got = sorted(map(tuple, QUERIES["stream_session"](spark, tables).collect()))
    assert got == [(7, "2024-01-01 00:00:00", 2, 2), (7, "2024-01-02 00:00:00", 1, 3), (8, "2024-01-02 01:00:00", 1, 4)]
