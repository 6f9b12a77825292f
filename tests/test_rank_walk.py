"""Ranks among the rows so far, against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from faultline.operators import features, rank_walk


@pytest.mark.parametrize("times", [3, 40, 10_000])
def test_pairs_are_counted_in_chunks(times, monkeypatch):
    monkeypatch.setattr(rank_walk, "CHUNK", 16)
    rng = np.random.default_rng(times)
    ts, x = np.sort(rng.integers(0, times, 500)), rng.integers(0, 50, 500) / 7
    want = ((ts[None, :] <= ts[:, None]) & (x[None, :] <= x[:, None])).sum(1)
    assert (rank_walk.upto(ts, x) == want).all()


SCHEMA = "repo string, file_path string, commit_id long, commit_date timestamp, a double, b int"


def rows_of(n, rng):
    for i in range(n):
        yield (
            None if i % 61 == 0 else f"r{i % 2}", f"f{i % 3}", i, None if i % 53 == 0 else datetime(2023, 1, 1) + timedelta(hours=int(rng.integers(0, 9000))),
            None if i % 7 == 0 else float(rng.integers(-20, 20)) / 3, int(rng.integers(0, 4)),
        )


def test_ranks_agree_with_brute_force(spark):
    """With gaps in every column, over many months; a snapshot crosses the network once to be ranked, whatever the columns."""
    rows = list(rows_of(400, np.random.default_rng(3)))
    df = features.causal_rank(spark.createDataFrame(rows, SCHEMA), ["a", "b"])
    assert "explode(sequence" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["commit_id"]: r for r in df.collect()}
    assert len(got) == 400 and df.columns == ["repo", "file_path", "commit_id", "commit_date", "a", "b", "rank_a", "rank_b"]
    for repo, _, i, at, *values in rows:
        for c, name in ((4, "a"), (5, "b")):
            mine, rank = values[c - 4], got[i][f"rank_{name}"]
            if repo is None or at is None or mine is None:
                assert rank is None
                continue
            past = [r[c] for r in rows if r[0] == repo and r[3] is not None and r[3] <= at and r[c] is not None]
            assert rank == pytest.approx(sum(v <= mine for v in past) / len(past), abs=1e-12)


def test_rows_of_one_key_share_the_greatest_rank(spark):
    rows = [("r", "f", 1, datetime(2024, 1, 1), 1.0, 0), ("r", "f", 1, datetime(2024, 5, 1), 0.0, 0), ("r", None, 2, datetime(2024, 5, 1), 5.0, 0)]
    got = features.causal_rank(spark.createDataFrame(rows, SCHEMA), ["a"]).collect()
    assert sorted((r["commit_id"], r["rank_a"]) for r in got if r["rank_a"] is not None) == [(1, 1.0), (1, 1.0)] and len(got) == 3
