"""Rows that earlier rules left out: tables of any number of knots, sources of any size."""

import pytest

from faultline.operators.features import quantile_rank
from faultline.plans.sources import line_table


def test_quantile_rank_any_table_length(spark):
    knots = [0.0, 10.0, 20.0, 50.0, 100.0, 500.0, 1000.0]
    table = spark.createDataFrame([("x", i, v) for i, v in enumerate(knots)], "feature string, idx int, value double")
    probes = spark.createDataFrame([(-1.0,), (100.0,), (75.0,), (50000.0,), (None,)], "x double")
    got = [r.qrank_x for r in quantile_rank(probes, ["x"], table).collect()]
    assert got == pytest.approx([0.01, 0.01 + 0.98 * 4 / 6, 0.01 + 0.98 * 3.5 / 6, 0.99, 0.5])


def test_large_sources_stay(spark):
    long = "x = 1\n" * 100_000
    src = spark.createDataFrame([("r", "a.py", long), ("r", "b.py", "y = 2\n")], "repo string, file_path string, source string")
    assert {r.file_path: r["count"] for r in line_table(src).groupBy("file_path").count().collect()} == {"a.py": 100_000, "b.py": 1}
