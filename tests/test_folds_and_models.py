import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import evaluation, folds, modelling


def frame(spark, days=200):
    return spark.range(days).select(
        F.lit("r").alias("repo"), F.concat(F.lit("f"), (F.col("id") / 4).cast("int").cast("string")).alias("canonical_file_id"),
        F.col("id").alias("commit_id"), F.timestamp_seconds(F.col("id") * 86400).alias("commit_date"), (F.col("id") % 5 == 0).cast("int").alias("future_bug_fix"),
    )


def test_temporal_folds_do_not_leak(spark):
    table = folds.temporal_folds(frame(spark), ["canonical_file_id", "repo", "ts", "future_bug_fix"], 10)
    for check in (folds.check_temporal(table), folds.check_identity(table)):
        folds.require_clean(check, "clean folds")
    assert table.select("fold").distinct().count() == 9


def test_leak_raises(spark):
    table = frame(spark).select(
        F.lit(0).alias("fold"), F.when(F.col("commit_id") % 2 == 0, "train").otherwise("test").alias("role"), "canonical_file_id", F.unix_timestamp("commit_date").alias("ts")
    )
    with pytest.raises(ValueError):
        folds.require_clean(folds.check_temporal(table), "time")
    with pytest.raises(ValueError):
        folds.require_clean(folds.check_identity(table), "identity")


def test_time_split_shares(spark):
    got = {r["role"]: r["count"] for r in folds.time_split(frame(spark), ["commit_id"]).groupBy("role").count().collect()}
    assert got == {"train": 140, "calibrate": 30, "test": 30}


def scores(spark, n=400):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, n)
    p = np.clip(np.round(0.3 * y + 0.7 * rng.random(n), 2), 0, 1)
    return y, p, spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")


def test_ap_and_roc_by_definition(spark):
    y, p, df = scores(spark)
    ap, prev = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        ap, prev = ap + (recall - prev) * precision, recall
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])
    assert abs(evaluation.average_precision(df, []).first()["pr_auc"] - ap) < 1e-9
    assert abs(evaluation.roc_auc(df, []).first()["roc_auc"] - auc) < 1e-9


def test_one_class(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, p double")
    assert evaluation.roc_auc(df, []).first()["roc_auc"] == 0.0
    row = evaluation.repo_evaluation(df.withColumn("repo", F.lit("r"))).where("repo = 'r'").first()
    assert row["roc_auc"] == 0.5 and row["lift"] == 0.0 and row["pr_auc"] == 1.0


def test_bootstrap_brackets_the_estimate(spark):
    _, _, df = scores(spark)
    for method in ("percentile", "bca"):
        a = evaluation.bootstrap_ci(df, replicates=150, method=method).first()
        b = evaluation.bootstrap_ci(df, replicates=150, method=method).first()
        assert a["lower"] < a["point_estimate"] < a["upper"]
        assert all(abs(a[c] - b[c]) < 1e-9 for c in ("lower", "upper", "std_error", "n_bootstrap"))


def test_acceleration_leaves_out_every_row(spark):
    """Against the average precision of the rows that remain; 300 rows are of one case, which says nothing alone."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.random() < 0.3 + q / 20), q / 10) for q in rng.integers(0, 11, 60).tolist()] + [(0, 0.3)] * 300

    def area(rest):
        out, positives = 0.0, sum(y for y, _ in rest)
        for q in {q for _, q in rest}:
            above = [y for y, r in rest if r >= q]
            out += sum(y for y, r in rest if r == q) / positives * sum(above) / len(above)
        return out

    for some in (rows, rows[:60], [(1, 0.9), (0, 0.8), (1, 0.5), (0, 0.1)], [(0, 0.9), (1, 0.2), (1, 0.2)]):
        values = np.array([area(some[:i] + some[i + 1 :]) for i in range(len(some))])
        d = values.mean() - values
        want = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
        points = evaluation.score_points(spark.createDataFrame(some, "y int, p double"), [])
        assert want != 0 and abs(evaluation._acceleration(points) - want) < 1e-9


def test_vif_of_a_known_matrix(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300), rng.normal(size=300)
    rows = [(float(x), float(z), float(x + 0.1 * z), 1.0) for x, z in zip(a, b)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = {r["feature"]: r["vif"] for r in modelling.vif(spark, df, ["a", "b", "c", "k"]).collect()}
    assert got["k"] is None and got["a"] == 10000.0
    kept = {r["feature"] for r in modelling.vif_screen(spark, df, ["a", "b", "c"], 10.0, protect=["c"]).collect() if r["removed_at"] is None}
    assert "c" in kept and len(kept) == 2


def test_preprocessing_uses_training_statistics_only(spark):
    train = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, None)], "id int, x double")
    other = spark.createDataFrame([(9, None)], "id int, x double")
    row = modelling.preprocess(other, train, ["x"]).first()["features"]
    filled = np.array([1.0, 3.0, 1.0])
    assert abs(row[0] - (1.0 - filled.mean()) / filled.std(ddof=1)) < 1e-9 and len(row) == 2


def test_a_forest_is_dealt_out_by_rows_and_trees(spark, monkeypatch):
    """One part of rows is fitted in as many tasks as rows times trees ask for, and rows that remember their nodes give the same forest."""
    monkeypatch.setattr(modelling, "VISITS_A_TASK", 1000, raising=False)
    rows = spark.range(0, 1000, 1, 1).select(F.pmod(F.hash("id"), F.lit(97)).alias("x"), F.pmod(F.hash("id"), F.lit(2)).alias("future_bug_fix"))
    context = spark.sparkContext
    context.setJobGroup("forest", "forest")
    fitted = modelling.train(rows, ["x"], "random_forest", numTrees=5, maxDepth=3)
    status = context.statusTracker()
    stages = [status.getStageInfo(s) for job in status.getJobIdsForGroup("forest") for s in status.getJobInfo(job).stageIds]
    assert max(s.numTasks for s in stages if s and "RandomForest" in s.name) == 5
    plain = modelling.train(rows, ["x"], "random_forest", numTrees=5, maxDepth=3, cacheNodeIds=False)
    assert fitted.score(rows).exceptAll(plain.score(rows)).isEmpty()
