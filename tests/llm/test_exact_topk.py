"""Exact top-k search against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import exact_topk

SCHEMA = "vec_id {}, embedding array<double>, row long, q int, key string, score long, ids int"


def by_hand(rows, asked, k=10):
    good = {(i, tuple(math.floor(1024 * v) for v in x)) for i, x in rows if i is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)}
    out = []
    for i, x in good:
        if asked(i):
            scored = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in good if (j, y) != (i, x))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, asked, kind="long", k=10):
    vectors = spark.createDataFrame([(i, x, 1, 2, "k", 3, 4) for i, x in rows], SCHEMA.format(kind)).repartition(5)
    return sorted(map(tuple, exact_topk.search(vectors, asked, k).collect()))


def made(seed, n, dims):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.15) for c in rng.choice(centres)]) for i in range(n)]
    hot = rows[0][1]  # a third of all rows hold one vector
    return [(i, hot if rng.random() < 0.33 else x) for i, x in rows]


@pytest.mark.parametrize("dims", [16, 7, 1])
def test_search(spark, monkeypatch, dims):
    for name, value in {"BLOCK": 64, "GROUP": 9, "LISTED": 12}.items():
        monkeypatch.setattr(exact_topk, name, value)
    rows = made(dims, 500, dims)
    assert found(spark, rows, F.col("vec_id") % 20 == 0) == by_hand(rows, lambda i: i % 20 == 0)
    assert found(spark, rows, F.col("vec_id") % 50 == 0, k=3) == by_hand(rows, lambda i: i % 50 == 0, 3)


def test_nodes_leave_low_entries_out(spark):
    rows = made(3, 2000, 16)
    classes = exact_topk.classes_of(exact_topk.rows_of(spark.createDataFrame([(i, x, 1, 2, "k", 3, 4) for i, x in rows], SCHEMA.format("long"))), 10)
    nodes = exact_topk.nodes_of(classes, 16)
    queries = np.array([[math.floor(1024 * v) for v in rows[1][1]]])
    scores = np.array([r["x"] for r in classes.orderBy("row").collect()]) @ queries[0]
    cutoff = np.sort(scores)[-11]
    entries = {r["row"] for r in exact_topk.high_entries(nodes, queries, np.array([cutoff]), 16).collect()}
    order = [r["row"] for r in classes.orderBy("row").select("row").collect()]
    assert {order[i] for i in np.flatnonzero(scores >= cutoff)} <= entries and len(entries) < len(scores) / 2


def test_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0, 0.5]), (100, [1.0, 2.0]), (7, [2.0, 4.0, 1.0]), (8, None), (9, [1.0, None]), (10, [nan, 1.0]), (11, [inf, 0.0]), (12, []), (None, [1.0, 1.0]), (200, [0.0, 0.0]), (13, [1.0, 2.0]), (300, [-0.0003, 1e4])]
    for kind in ("long", "int"):
        assert found(spark, rows, F.col("vec_id") % 100 == 0, kind) == by_hand(rows, lambda i: i % 100 == 0)
    assert found(spark, rows[:2], F.col("vec_id") % 100 == 0) == found(spark, [], F.col("vec_id") % 100 == 0) == found(spark, rows, F.lit(False)) == []


def test_large_numbers(spark):
    rows = [(i, [2.0**19 * (i + 1), -(2.0**20) * i, 3.25]) for i in range(12)]
    assert found(spark, rows, F.col("vec_id") == 0) == by_hand(rows, lambda i: i == 0)
