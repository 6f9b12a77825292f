"""Folds fitted together against folds fitted one by one, and the checks that stop an experiment."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import evaluation, experiments, modelling


def made(spark, n=1200, gaps=True):
    rng = np.random.default_rng(7)
    a, b, c = rng.normal(3, 2, n), rng.exponential(2, n), rng.integers(0, 2, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * (a - 3) - 0.5 * b + c)))).astype(int)
    rows = [
        (f"r{rng.integers(0, 4)}", f"f{i // 3}", i, 86400 * i, None if gaps and rng.random() < 0.1 else float(a[i]), None if gaps and rng.random() < 0.05 else float(b[i]), int(c[i]), int(y[i]))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "repo string, canonical_file_id string, commit_id long, t long, code_loc double, code_sloc double, code_function_count int, future_bug_fix int")
    return df.withColumn("commit_date", F.timestamp_seconds("t")).repartition(5), rows


def one_fold(train, test, penalty=0.01):
    """Probabilities of `test` by a model of `train`, rows (x, y): filled, flagged, scaled and fitted by plain Newton steps."""
    x, y = np.array([[np.nan if v is None else v for v in r[0]] for r in train], float), np.array([r[1] for r in train], float)
    medians = np.nanmedian(x, axis=0)
    flagged = np.flatnonzero(np.isnan(x).any(axis=0))
    full = lambda m: np.column_stack([np.where(np.isnan(m), medians, m), np.isnan(m)[:, flagged]])
    mean, deviation = full(x).mean(0), full(x).std(0)
    scaled = lambda m: np.column_stack([np.ones(len(m)), (full(m) - mean) / np.where(deviation > 1e-6, deviation, np.inf)])
    z, weight = scaled(x), np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, free = np.zeros(z.shape[1]), np.r_[0, np.full(z.shape[1] - 1, penalty)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ (weight * (p - y)) / len(y) + free * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z / len(y) + np.diag(free + 1e-12)
        w = w - np.linalg.solve(h, g)
    other = np.array([[np.nan if v is None else v for v in r[0]] for r in test], float)
    return 1 / (1 + np.exp(-scaled(other) @ w))


COLUMNS = ["code_loc", "code_sloc", "code_function_count"]


@pytest.mark.parametrize("regime", ["lopo", "temporal"])
def test_all_folds_at_once_equal_single_fits(spark, regime):
    df, rows = made(spark)
    if regime == "lopo":
        table, names = modelling.lopo_rows(df)
        sides = {f: ([r for r in rows if r[0] != n], [r for r in rows if r[0] == n]) for n, f in names.items()}
    else:
        table, names = modelling.temporal_rows(df, 5)
        last = max(r[3] for r in rows)
        first = {r[1]: min(x[3] for x in rows if x[1] == r[1]) for r in rows}
        sides = {f: ([r for r in rows if r[3] <= last * (f + 1) / 5], [r for r in rows if last * (f + 1) / 5 < r[3] <= last * (f + 2) / 5 and first[r[1]] > last * (f + 1) / 5]) for f in range(4)}
    prepared, flagged, scales = experiments.prepared(table, COLUMNS, ["commit_id"])
    assert flagged == ["code_loc", "code_sloc"]
    fitted = experiments.fit(prepared, flagged, scales, COLUMNS, len(names))
    got = {(r["fold"], r["commit_id"]): (r["y"], r["p"]) for r in experiments.scores(prepared, fitted, ["commit_id"]).collect()}
    assert len(names) == 4
    want = {}
    for fold, (train, test) in sides.items():
        p = one_fold([(r[4:7], r[7]) for r in train], [(r[4:7], r[7]) for r in test])
        want |= {(fold, r[2]): (r[7], q) for r, q in zip(test, p)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_metrics_come_from_the_scores(spark):
    df, _ = made(spark, gaps=False)
    table, names = modelling.lopo_rows(df)
    scored = modelling.fold_scores(table, len(names), COLUMNS, "logistic_regression", {}).toPandas()
    got = {r["key"]: r for r in modelling.run_lopo(df, "logistic_regression", "A").collect()}
    assert set(got) == set(names)
    for key, own in scored.groupby("_key"):
        brier = ((own.p - own.y) ** 2).mean()
        hit = own[own.p >= 0.5]
        assert got[key]["n_test"] == len(own) and abs(got[key]["brier_score"] - brier) < 1e-9 and abs(got[key]["precision"] - hit.y.mean()) < 1e-9


def test_tree_folds_run_side_by_side(spark):
    df, _ = made(spark, 400, gaps=False)
    rows, names = modelling.lopo_rows(df)
    scored = modelling.fold_scores(rows, len(names), COLUMNS, "random_forest", {"numTrees": 3, "maxDepth": 3})
    assert scored.count() == 400 and scored.where("p < 0 OR p > 1").count() == 0 and scored.select("fold").distinct().count() == len(names)


def test_small_and_leaking_folds_raise(spark):
    df, _ = made(spark, 200, gaps=False)
    with pytest.raises(ValueError):
        modelling.run_lopo(df, "logistic_regression", "A", min_test=150)
    with pytest.raises(ValueError):
        modelling.run_temporal_cv(df, "logistic_regression", "A", min_train=1000)


def test_one_class_and_empty_folds(spark):
    df, _ = made(spark, 300, gaps=False)
    rows, names = modelling.lopo_rows(df.withColumn("future_bug_fix", F.lit(1)))
    assert {r["p"] for r in modelling.fold_scores(rows, len(names), COLUMNS, "logistic_regression", {}).collect()} == {0.5}
    empty = modelling.run_temporal_cv(df.limit(0), "logistic_regression", "A")
    assert empty.count() == 0 and empty.columns == modelling.run_lopo(df, "logistic_regression", "A").columns


def test_best_configuration_is_refitted_and_calibrated(spark):
    df, rows = made(spark, gaps=False)
    results = modelling.run_all(df, ["logistic_regression"], ["A"], 5)
    assert {r["regime"] for r in results.select("regime").distinct().collect()} == {"temporal_cv", "lopo"}
    name, group, fitted = modelling.refit_best(df, results, ["commit_id"])
    out = fitted.score(df)
    assert (name, group) == ("logistic_regression", "A") and out.columns == [*df.columns, "p"]
    shares = out.groupBy(F.floor(F.col("p") * 4)).agg(F.avg("p").alias("p"), F.avg("future_bug_fix").alias("y"), F.count("*").alias("n")).where("n > 100").collect()
    assert len(shares) >= 2 and all(abs(r["p"] - r["y"]) < 0.12 for r in shares)
    assert evaluation.roc_auc(out, [], y="future_bug_fix").first()["roc_auc"] > 0.75


def test_shuffled_columns_are_permutations(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i), None if i % 3 else 1.0) for i in range(50)], "id int, a double, b double, c double").repartition(4)
    rows = modelling.shuffled(df, ["a", "b", "c"], ["id"]).collect()
    assert sorted(r.id for r in rows) == list(range(50))
    for c in "abc":
        assert sorted(str(r._shuffled[c]) for r in rows) == sorted(str(r[c]) for r in rows)
    assert all(r._shuffled.a != r.a for r in rows) and any(r._shuffled.a ** 2 != r._shuffled.b for r in rows)
    assert [r._shuffled.a for r in modelling.shuffled(df.where("id = 7"), ["a"], ["id"]).collect()] == [7.0]
    assert modelling.shuffled(df.limit(0), ["a"], ["id"]).count() == 0


def test_importance_of_a_used_and_an_unused_column(spark):
    df, _ = made(spark, gaps=False)
    got = {r.feature: r.importance for r in modelling.permutation_importance(modelling.LinearScore({"code_loc": 1, "code_function_count": 0}), df, ["commit_id"]).collect()}
    assert got["code_loc"] > 0.05 and got["code_function_count"] == 0.0


def test_rows_go_to_the_model_of_their_engine(spark):
    from faultline.operators import scoring, source_metrics

    class Given:
        def __init__(self, value):
            self.value = value

        def score(self, df, out="p"):
            return df.withColumn(out, F.when(F.col("loc") > 0, F.lit(self.value)))

    rows = [("r", "a.py", "def f(a):\n    return a\n"), ("r", "B.java", "class B {\n  int f(int a) {\n    return a;\n  }\n}\n"), ("r", "c.go", "func f() {\n}\n"), ("r", "d.py", "")]
    metrics = source_metrics.smell_flags_by_language(source_metrics.code_metrics(spark.createDataFrame(rows, "repo string, file_path string, source string")))
    assert {r.file_path: r.ruleset for r in metrics.collect()} == {"a.py": "python", "B.java": "java", "c.go": "polyglot", "d.py": "python"}
    for ruleset in ("python", "java", "polyglot"):
        own = metrics.where(F.col("ruleset") == ruleset)
        plain = source_metrics.smell_flags(own.drop("ruleset", "total_smells", *source_metrics.SMELL_FLAGS, *source_metrics.SMELL_COUNTS), ruleset)
        names = ["file_path", "total_smells", *source_metrics.SMELL_FLAGS, *source_metrics.SMELL_COUNTS]
        assert sorted(own.select(names).collect()) == sorted(plain.select(names).collect())
    routed = metrics.withColumn("engine", F.when(F.col("file_path") == "B.java", "full").otherwise("static"))
    heuristic = scoring.heuristic_of_ruleset()
    score = lambda models: {r.file_path: (r.engine, r.risk_probability) for r in modelling.score_batch(routed, models, heuristic).collect()}
    got = score({"static": Given(0.2), "full": Given(0.999)})
    assert got["a.py"] == got["c.go"] == ("static", 0.2) and got["B.java"] == ("full", 0.99) and got["d.py"][0] == "heuristic_fallback"
    assert score({"static": Given(0.2)})["B.java"] == ("static", 0.2)
    assert {e for e, _ in score({}).values()} == {"heuristic_fallback"}
