"""Trees fitted on cells: rows that lie in the same bins, with the number of their copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import cells, modelling
from faultline.plans import modelling as plans


def made(spark, n=4000, parts=4):
    noise = F.pmod(F.hash("id", F.lit(3)), F.lit(100))
    rows = spark.range(0, n, 1, parts).select(
        "id", F.pmod(F.hash("id"), F.lit(6)).alias("a"), F.when(F.col("id") % 50 > 0, F.pmod(F.hash("id", F.lit(7)), F.lit(3))).alias("b")
    )
    return rows.withColumn("future_bug_fix", (noise < F.when(F.col("a") > 2, 80).otherwise(25)).cast("int"))


def by_cell(scored):
    return {(r["a"], r["b"]): r["p"] for r in scored.groupBy("a", "b").agg(F.avg("p").alias("p")).collect()}


def test_draws_are_poisson_and_belong_to_their_cell():
    copies, keys = np.array([1, 3, 1000, 70_000]), np.array([11, -5, 2**62, 0])
    drawn = cells.draws(copies, keys, range(3000), 42)
    assert np.allclose(drawn.mean(1), copies, rtol=0.07) and np.allclose(drawn.var(1), copies, rtol=0.15)
    assert abs(np.corrcoef(drawn)[np.triu_indices(4, 1)]).max() < 0.1
    assert (cells.draws(copies[::-1], keys[::-1], [5, 7], 42) == drawn[::-1, [5, 7]]).all()


def test_borders_cut_into_even_bins(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    found = cells.borders(df, ["x", "y"], 4)
    assert found["y"] == (0.0, 1.0) and len(found["x"]) == 3
    sizes = [r["count"] for r in cells.cut(df, found).groupBy("x").count().orderBy("x").collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2


def test_a_forest_beyond_many_rows_times_trees_is_fitted_on_cells(spark, monkeypatch):
    """The forest is the same however rows are dealt out, passes over cells only, and tells what one by rows does."""
    monkeypatch.setattr(modelling, "VISITS_BY_ROWS", 0, raising=False)
    passed = []
    fit = cells.fit
    monkeypatch.setattr(cells, "fit", lambda ready, *rest: passed.append(ready.count()) or fit(ready, *rest))
    rows = made(spark)
    one, other = (modelling.train(r, ["a", "b"], "random_forest", numTrees=30, maxDepth=4) for r in (rows, rows.repartition(7)))
    assert by_cell(one.score(rows)) == pytest.approx(by_cell(other.score(rows)), abs=1e-9)
    assert passed == [6 * 4 * 2] * 2 and one.model.stages[-1].getNumTrees == 30
    assert one.score(rows).columns == [*rows.columns, "p"] and one.score(rows).count() == 4000
    monkeypatch.setattr(modelling, "VISITS_BY_ROWS", 10**9)
    plain = by_cell(modelling.train(rows, ["a", "b"], "random_forest", numTrees=30, maxDepth=4).score(rows))
    assert by_cell(one.score(rows)) == pytest.approx(plain, abs=0.12)


def test_boosted_trees_on_cells_are_those_by_rows(spark):
    from pyspark.ml import Pipeline

    rows = made(spark)
    ready = modelling.doubles(rows.select(modelling.LABEL, "a", "b"), ["a", "b"])
    stages, flagged, fills = modelling.preprocessor(ready, ["a", "b"])
    model = Pipeline(stages=[*stages, modelling.classifier("boosted", maxIter=5)]).fit(modelling.with_class_weights(modelling.with_flags(ready, flagged, fills)))
    plain = by_cell(modelling.Fitted(model, ["a", "b"], flagged, fills).score(rows))
    assert by_cell(modelling.train(rows, ["a", "b"], "boosted", maxIter=5).score(rows)) == pytest.approx(plain, abs=1e-9)


def test_the_boosted_query_runs_all_rounds(spark, monkeypatch):
    seen = []

    class Score:
        def score(self, df):
            return df.withColumn("p", F.lit(0.5))

    def train(df, columns, name, **overrides):
        seen.append(modelling.classifier(name, **overrides))
        return Score()

    monkeypatch.setattr(plans.op, "train", train)
    rows = [("r", f"f{i}", i, i, i % 2) for i in range(20)]
    sn = spark.createDataFrame(rows, "repo string, file_path string, commit_id long, day int, future_bug_fix int")
    plans.train_boosted(sn.withColumn("commit_date", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, day)")))
    assert seen[0].getMaxIter() == 300 and seen[0].getMaxDepth() == 5
