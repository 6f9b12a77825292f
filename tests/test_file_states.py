"""Histories walked by file and quarter, against a brute-force version."""

import math
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np

from faultline.operators import file_states, history

DAY = timedelta(days=1)
CHANGES = "repo string, file_path string, commit_id long, author string, commit_date timestamp, message string, lines int, is_bug_fix boolean"
TEXTS = ["Fix a crash\tin parser", "fix fix  FIX", "", None, "add x\n", "ÄÖ straße fix", " a b c "]


def made(n, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        day = int(rng.integers(0, 500))
        out.append((
            f"r{i % 2}", None if i % 41 == 0 else f"f{rng.integers(0, 3)}.py", i, [None, "a", "b", "c"][rng.integers(0, 4)],
            datetime(2023, 1, 1) + day * DAY + timedelta(seconds=int(rng.integers(0, 2))), TEXTS[rng.integers(0, len(TEXTS))],
            None if i % 13 == 0 else int(rng.integers(0, 50)), bool(rng.integers(0, 2)),
        ))
    return out


def expected(changes, repo, path, at):
    past = sorted((c for c in changes if c[0] == repo and c[1] == path and c[4] < at), key=lambda c: c[4])
    if not past:
        return (0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    authors = Counter(c[3] or "" for c in past)
    words = Counter(w for c in past for w in re.split(r"\s+", (c[5] or "").lower()) if w)
    total = sum(words.values())
    entropy = math.log2(total) - sum(c * math.log2(c) for c in words.values()) / total if total else 0.0
    return (
        len(past), sum(c[7] for c in past), len(authors), sum(c[4] >= at - 30 * DAY for c in past), sum(c[6] or 0 for c in past),
        (at - past[0][4]) / DAY, (at - past[-1][4]) / DAY, max(authors.values()) / len(past), entropy,
    )


NAMES = ["previous_file_commits", "previous_bug_fixes", "contributors", "recent_file_commits", "code_churn_history",
         "file_age_days", "days_since_last_change", "ownership_concentration", "commit_message_entropy"]


def test_histories_agree_with_brute_force(spark):
    """With quarters that have snapshots only, several of a time, and files without changes."""
    rows = made(400)
    changes = spark.createDataFrame(rows, CHANGES)
    asked = [(r[0], r[1], i, r[4] + int(i % 5) * 40 * DAY) for i, r in enumerate(rows)] + [("r0", "new.py", 1000, datetime(2024, 1, 1)), ("r0", "f1.py", 1001, None)]
    snapshots = spark.createDataFrame(asked + asked[:1] + asked[2:3], "repo string, file_path string, commit_id long, commit_date timestamp")
    got = history.file_history(changes, snapshots).collect()
    wanted = [a for a in (*asked, asked[0], asked[2]) if a[1] is not None and a[3] is not None]
    assert Counter(r["commit_id"] for r in got) == Counter(a[2] for a in wanted)
    for r in got:
        want = expected(rows, r["repo"], r["file_path"], r["commit_date"])
        assert np.allclose([r[n] for n in NAMES], want, atol=6e-5), (r, want)


def test_changes_cross_the_network_as_they_are(spark):
    """What is dealt out to be walked is a row for a change, not one for each word; and a walk keeps its file from batch to batch."""
    message = " ".join(f"w{i}" for i in range(500))
    rows = [("r", "f", i, "a", datetime(2024, 1, 1) + i * DAY / 10, message, 1, False) for i in range(60)]
    changes = spark.createDataFrame(rows, CHANGES)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = history.file_history(changes, changes.select("repo", "file_path", "commit_id", "commit_date"))
        counts = {r["commit_id"]: (r["previous_file_commits"], r["commit_message_entropy"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert counts == {i: (i, round(math.log2(500), 4) if i else 0.0) for i in range(60)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange") <= 8


def test_recent_changes_reach_over_quarters(spark):
    """Also where the recent time is longer than a quarter."""
    rows = [("r", "f", i, "a", datetime(2024, 1, 1) + i * 20 * DAY, "x", 1, False) for i in range(30)]
    stamped = history.with_ts(spark.createDataFrame(rows, CHANGES))
    got = file_states.states_before(stamped, stamped.select("repo", "file_path", "commit_id", "ts"), 200).select("row.commit_id", "recent").collect()
    assert {r["commit_id"]: r["recent"] for r in got} == {i: min(i, 10) for i in range(30)}
