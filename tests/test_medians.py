"""Medians that fill gaps: exact, lower, and never a whole column in one place."""

import inspect

import pytest

from faultline.operators import modelling


def test_lower_medians_by_hand(spark):
    rows = [(1.0, -5.0), (4.0, None), (2.0, float("nan")), (3.0, 7.0), (None, 0.0), (3.0, -0.5)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert modelling.medians(df, ["a", "b"]) == {"a": 3.0, "b": -0.5}
    even = spark.createDataFrame([(x,) for x in (4.0, 1.0, 3.0, 2.0)], "a double")
    assert modelling.medians(even, ["a"]) == {"a": 2.0}


def test_column_without_values(spark):
    with pytest.raises(ValueError, match="no median"):
        modelling.medians(spark.createDataFrame([(None,)], "a double"), ["a"])


def test_no_stage_gathers_a_column():
    assert "Imputer" not in inspect.getsource(modelling)
