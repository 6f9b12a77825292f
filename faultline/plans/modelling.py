"""Registered queries on Spark ML. Small settings keep the checks short; rows are never left out."""

from pyspark.sql import functions as F

from faultline.operators import folds, scoring
from faultline.operators import modelling as op
from faultline.operators import source_metrics
from faultline.operators.commits import score_commits
from faultline.plans.evaluation import AP, curve_sql, rounded
from faultline.plans.features import with_history
from faultline.plans.folds import units
from faultline.plans.registry import query, query_on_dir
from faultline.session import materialize

ROW = ["repo", "file_path", "commit_id"]
COLUMNS = ["code_loc", "code_max_cyclomatic_complexity", "code_max_nesting_depth", "total_smells", "has_large_class", "has_deep_nesting", "has_high_complexity"]
NUMERIC = COLUMNS[:4]


def split(sn):
    parts = materialize(folds.time_split(sn, ROW), "split")
    return [parts.where(F.col("role") == r).drop("role") for r in ("train", "calibrate", "test")]


@query("preprocess", "SN")
def preprocess(sn):
    """Scaled features with gaps filled, fitted on the training part only."""
    holes = sn.withColumn("code_loc", F.when(F.col("code_loc") % 7 > 0, F.col("code_loc")))
    out = op.preprocess(holes.select(*ROW, *NUMERIC), split(holes)[0].select(*ROW, *NUMERIC), NUMERIC)
    return out.select(*ROW, F.transform("features", lambda x: F.round(x, 6)).alias("features"))


@query(
    "class_weights", "SN",
    """SELECT repo, file_path, commit_id, (SELECT count(*) FROM sn_snapshots) / (2e0 * (SELECT count(*) FROM sn_snapshots x WHERE x.future_bug_fix = s.future_bug_fix)) AS class_weight FROM sn_snapshots s""",
)
def class_weights(sn):
    return op.with_class_weights(sn).select(*ROW, "class_weight")


def scores(sn, name, **overrides):
    train_rows, _, test_rows = split(sn)
    return op.train(train_rows, COLUMNS, name, **overrides).score(test_rows).select(*ROW, "future_bug_fix", "p")


@query("train_logreg", "SN")
def train_logreg(sn):
    return scores(sn, "logistic_regression")


@query("train_forest", "SN")
def train_forest(sn):
    return scores(sn, "random_forest")


@query("train_boosted", "SN")
def train_boosted(sn):
    return scores(sn, "boosted")


@query("tune", "SN")
def tune(sn):
    return op.tune(units(sn), NUMERIC, "logistic_regression", [{"regParam": r} for r in (0.001, 0.01, 0.1, 1.0, 10.0)], 10, "unit")


def held_out(pr):
    """Scores of one half for fitting, the other for use."""
    base = pr.select(*ROW, F.col("y").alias("future_bug_fix"), F.col("p_full").alias("p"))
    return base.where("commit_id % 2 = 0"), base.where("commit_id % 2 = 1")


@query("calibrate_sigmoid", "PR")
def calibrate_sigmoid(pr):
    fit, use = held_out(pr)
    return op.calibrate_sigmoid(fit)(use)


@query("calibrate_isotonic", "PR")
def calibrate_isotonic(pr):
    fit, use = held_out(pr)
    return op.calibrate_isotonic(fit)(use)


@query("run_temporal_cv", "SN")
def run_temporal_cv(sn):
    return op.run_temporal_cv(units(sn), "logistic_regression", "C", file="unit")


@query("run_lopo", "SN")
def run_lopo(sn):
    return op.run_lopo(sn, "logistic_regression", "A")


@query("run_all", "SN")
def run_all(sn):
    """One model on the three groups that the snapshots tell apart, in both regimes, at default settings."""
    return op.run_all(units(sn), ["logistic_regression"], ["A", "B", "C"], file="unit")


@query("refit_best", "SN")
def refit_best(sn):
    """Calibrated probabilities of all snapshots by the best configuration over the folds."""
    rows = units(sn)
    results = op.run_all(rows, ["logistic_regression"], ["A", "C"], file="unit")
    name, group, fitted = op.refit_best(rows, results, ROW)
    return fitted.score(rows).select(*ROW, F.lit(name).alias("model"), F.lit(group).alias("feature_group"), "p")


@query_on_dir("vif", "SN")
def vif(spark, sf_dir, sn):
    return op.vif(spark, sn.withColumn("constant", F.lit(1)), [*COLUMNS, "constant"])


@query_on_dir("vif_screen", "SN")
def vif_screen(spark, sf_dir, sn):
    return op.vif_screen(spark, sn, COLUMNS, 2.0, protect=["has_large_class"])


@query(
    "correlation_matrix", "SN",
    "\nUNION ALL ".join(
        f"SELECT '{NUMERIC[i]}' AS a, '{NUMERIC[j]}' AS b, round(corr({NUMERIC[i]}, {NUMERIC[j]}), 8) AS r FROM sn_snapshots" for i in range(len(NUMERIC)) for j in range(i)
    ),
)
def correlation_matrix(sn):
    return rounded(op.correlation_matrix(sn, NUMERIC))


WEIGHTS = {"code_loc": 0.002, "code_max_cyclomatic_complexity": -0.05, "total_smells": 0.7}


@query(
    "linear_contributions", "SN",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg(abs({w}::DOUBLE * ({c} - (SELECT avg({c}) FROM sn_snapshots)))), 8) AS importance FROM sn_snapshots" for c, w in WEIGHTS.items()
    ),
)
def linear_contributions(sn):
    return rounded(op.linear_contributions(sn, WEIGHTS))


@query("permutation_importance", "SN")
def permutation_importance(sn):
    """Of a fitted model, all its features."""
    sn = materialize(sn, "train")
    return op.permutation_importance(op.train(sn, NUMERIC, "logistic_regression"), sn, ROW)


#: A given score, whole numbers, so that both engines rank alike.
SCORE = {"code_loc": 2, "code_max_cyclomatic_complexity": -55, "total_smells": 700}


def _permutation_sql():
    def moved(c):
        return f"(SELECT 1 + ('0x' || substr(md5('42|{c}'), 1, 8))::BIGINT % (count(*) - 1) FROM sn_snapshots)"

    def score(shuffled):
        return " + ".join(f"{w} * {'g' if c == shuffled else 'r'}.{c}" for c, w in SCORE.items())

    cases = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, r.future_bug_fix AS y, ({score(c)})::DOUBLE AS p FROM r JOIN r g ON g.place = (r.place + {moved(c) if c else 0}) % r.n" for c in ("", *SCORE)
    )
    return f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42|', repo, '|', file_path, '|', commit_id)), repo, file_path, commit_id) - 1 AS place, count(*) OVER () AS n FROM sn_snapshots),
cases AS ({cases}), {curve_sql('cases', ['feature'], 'p')},
areas AS (SELECT feature, {AP} AS ap FROM pts GROUP BY 1)
SELECT feature, round((SELECT ap FROM areas WHERE feature = '') - ap, 8) AS importance FROM areas WHERE feature <> ''"""


@query("permutation_importance_given", "SN", _permutation_sql())
def permutation_importance_given(sn):
    """Of a given linear score."""
    return rounded(op.permutation_importance(op.LinearScore(SCORE), sn, ROW))


#: The history knows files as src/mod7.py, the sources as src/f7.py: the same files under these names.
TRACKED = "replace(file_path, 'mod', 'f')"
HISTORY = ["previous_file_commits", "previous_bug_fixes", "contributors"]


def routed(src, fc):
    """Metrics and smells of sources by the rules of their language, telemetry and engine of each file."""
    metrics = source_metrics.smell_flags_by_language(source_metrics.code_metrics(src))
    telemetry = score_commits(fc).withColumn("file_path", F.expr(TRACKED)).groupBy("repo", "file_path").agg(
        F.count(F.lit(1)).alias("previous_file_commits"), F.count_if("is_bug_fix").alias("previous_bug_fixes"), F.countDistinct("author").alias("contributors")
    )
    known = scoring.attach_telemetry(metrics, telemetry)
    return known.withColumn("engine", F.when(F.col("is_tracked"), "full").otherwise("static"))


@query(
    "score_routes", "SRC FC",
    f"""SELECT s.repo, s.file_path, CASE WHEN ends_with(s.file_path, '.py') THEN 'python' WHEN ends_with(s.file_path, '.java') THEN 'java' ELSE 'polyglot' END AS ruleset,
  t.file_path IS NOT NULL AS is_tracked, CASE WHEN t.file_path IS NOT NULL THEN 'full' ELSE 'static' END AS engine, coalesce(t.n, 0) AS previous_file_commits, coalesce(t.authors, 1) AS contributors
FROM src_sources s LEFT JOIN (SELECT repo, {TRACKED} AS file_path, count(*) AS n, count(DISTINCT author) AS authors FROM fc_file_changes GROUP BY 1, 2) t USING (repo, file_path)""",
)
def score_routes(src, fc):
    """Which rules and which engine each source goes to."""
    return routed(src, fc).select("repo", "file_path", "ruleset", "is_tracked", "engine", "previous_file_commits", "contributors")


@query("score_batch", "SRC FC SN")
def score_batch(src, fc, sn):
    """Sources to metrics and risk: tracked files by a model with history, others by a static one, both fitted on all snapshots."""
    rows = materialize(with_history(sn, fc).select("future_bug_fix", *NUMERIC, *HISTORY), "train")
    models = {"static": op.train(rows, NUMERIC, "logistic_regression"), "full": op.train(rows, [*NUMERIC, *HISTORY], "logistic_regression")}
    names = {"code_loc": "loc", "code_max_cyclomatic_complexity": "max_cyclomatic_complexity", "code_max_nesting_depth": "max_nesting_depth"}
    features = routed(src, fc).withColumns({c: F.col(n) for c, n in names.items()})
    return op.score_batch(features, models, scoring.heuristic_of_ruleset()).select("repo", "file_path", "ruleset", "engine", "risk_probability", "risk_tier")
