"""A row's place in a quantile table is searched once."""

from faultline.operators.features import quantile_rank


def test_one_search_for_each_table(spark):
    table = spark.createDataFrame([(f, i, float(i * i)) for f in "xy" for i in range(11)], "feature string, idx int, value double")
    probes = spark.createDataFrame([(2.5, 81.0), (-1.0, 100.0), (None, 0.0)], "x double, y double")
    ranks = quantile_rank(probes, ["x", "y"], table)
    assert ranks._jdf.queryExecution().optimizedPlan().toString().count("aggregate(sequence") == 2
    got = [(round(r.qrank_x, 6), round(r.qrank_y, 6)) for r in ranks.collect()]
    assert got == [(round(0.01 + 0.098 * 1.5, 6), round(0.01 + 0.098 * 9, 6)), (0.01, 0.99), (0.5, 0.01)]
