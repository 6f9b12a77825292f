"""Streams over several batches: late rows, closed windows, timers, and results that do not depend on how rows are dealt to batches."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.plans.streams import rocksdb
from faultline.streaming import streams

START = datetime(2024, 1, 1)
HOUR = 3600


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(spark, folder, batches, schema, build):
    """The rows that leave `build`, a stream, when each of `batches` comes in a file and a batch of its own."""
    os.makedirs(f"{folder}/in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{i}")
        (name,) = [x for x in os.listdir(f"{folder}/part{i}") if x.endswith(".parquet")]
        os.rename(f"{folder}/part{i}/{name}", f"{folder}/in/{i:03}.parquet")
        os.utime(f"{folder}/in/{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with rocksdb(spark):
        streams.run_to_parquet(build(stream), f"{folder}/out", f"{folder}/state")
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))


def in_batches(rows, time, spread, size, seed):
    """Rows in time order but for up to `spread` seconds, `size` to a batch."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: (time(r) + rng.random() * spread, rng.random()))
    return [order[a : a + size] for a in range(0, len(order), size)]


def test_windows_leave_once_closed_and_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, is_bug_fix boolean"
    day = 24 * HOUR
    batches = [[(at(0), True), (at(5 * HOUR), False)], [(at(3 * day), True)], [(at(3 * day + HOUR), False)], [(at(6 * HOUR), True), (at(2.5 * day), False)], [(at(9 * day), False)]]
    got = run(spark, tmp_path, batches, schema, lambda s: streams.windowed_fixes(s, "ts", "1 day", delay="1 day"))
    # the watermark that the second batch sets closes windows in the third and drops late rows from the fourth on
    assert got == [(at(0), at(day), 2, 1), (at(2 * day), at(3 * day), 1, 0), (at(3 * day), at(4 * day), 2, 1)]


def test_sessions_leave_once_closed(spark, tmp_path):
    schema = "ts timestamp, who string, value long"
    batches = [[(at(0), "a", 1), (at(600), "a", 2)], [(at(1200), "a", 3), (at(0), "b", 9)], [(at(5 * HOUR), "a", 4)]]
    got = run(spark, tmp_path, batches, schema, lambda s: streams.edit_sessions(s, "who", "ts", "value"))
    assert got == [("a", at(0), at(1200 + 1800), 3, 3), ("b", at(0), at(1800), 1, 9)]


def test_keys_leave_again_when_their_state_is_freed(spark, tmp_path):
    schema = "ts timestamp, id string"
    batches = [[(at(0), "x")], [(at(HOUR), "x"), (at(HOUR), "y")], [(at(100 * HOUR), "z")], [(at(100 * HOUR), "w")], [(at(101 * HOUR), "x")]]
    got = run(spark, tmp_path, batches, schema, lambda s: streams.dedup_stream(s, ["id"], "ts", "2 days").select("id"))
    assert got == [("w",), ("x",), ("x",), ("y",), ("z",)]


def made(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(4), i, at(rng.randrange(20 * 24 * HOUR) + rng.choice([0, 0.5])), rng.choice("abc"), rng.random() < 0.3) for i in range(n)]


EVENT = "file long, event_id long, ts timestamp, kind string, is_fix boolean"
DELAY = timedelta(days=1)


@pytest.mark.parametrize("size,spread,seed", [(400, 0, 1), (37, 20 * HOUR, 2), (90, 20 * HOUR, 3)])
def test_history_and_newest_do_not_depend_on_batches(spark, tmp_path, size, spread, seed):
    rows = made(0, 400)
    batches = in_batches(rows, lambda r: (r[2] - START).total_seconds(), spread, size, seed)
    closed = max(r[2] for r in rows) - DELAY
    want = []
    for file, i, t, kind, fix in rows:
        if t <= closed:
            before = sorted((x[2], x[1], x[3], x[4]) for x in rows if x[0] == file and (x[2], x[1]) < (t, i))
            ages = ((t - before[0][0]).total_seconds() / 86400, (t - before[-1][0]).total_seconds() / 86400) if before else (0.0, 0.0)
            want.append((file, i, len(before), sum(x[3] for x in before), len({x[2] for x in before}), *ages))
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = run(spark, tmp_path / "history", batches, EVENT, streams.file_history_stream)
        newest = run(spark, tmp_path / "newest", batches, EVENT, lambda s: streams.newest_stream(s.select("file", "event_id", "ts"), 5))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", conf)
    assert [r[:5] for r in got] == [r[:5] for r in sorted(want)]
    assert all(a == pytest.approx(b, abs=1e-6) for a, b in zip([x for r in got for x in r[5:]], [x for r in sorted(want) for x in r[5:]]))
    joined = []
    for file in range(4):
        own = [i for _, i in sorted((t, i) for f, i, t, _, _ in rows if f == file and t <= closed)]
        joined += [(file, i, own[k - 5] if k >= 5 else None) for k, i in enumerate(own)]
    assert sorted(newest, key=str) == sorted(joined, key=str)


@pytest.mark.parametrize("size,spread,seed", [(500, 0, 1), (41, 20 * HOUR, 2), (120, 20 * HOUR, 3)])
def test_labels_leave_once_when_their_window_is_over(spark, tmp_path, size, spread, seed):
    rng = random.Random(4)
    rows = [(f"f{rng.randrange(6)}", i, at(rng.randrange(30 * 24) * HOUR), rng.random() < 0.12) for i in range(500)]
    batches = in_batches(rows, lambda r: (r[2] - START).total_seconds(), spread, size, seed)
    width = timedelta(days=3)
    closed = max(r[2] for r in rows) - DELAY
    want = [(f, i, int(any(g == f and fix and t < u <= t + width for g, _, u, fix in rows))) for f, i, t, fix in rows if not fix and t + width <= closed]
    build = lambda s: streams.label_stream(s.where("not is_fix"), s.where("is_fix").select("file", "ts"), 3)
    got = run(spark, tmp_path, batches, "file string, id long, ts timestamp, is_fix boolean", build)
    assert got == sorted(want) and 0 < sum(r[2] for r in want) < len(want)
