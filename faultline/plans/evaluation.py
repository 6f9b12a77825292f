"""Registered queries on evaluation statistics."""

from pyspark.sql import functions as F

from faultline.operators import evaluation as op
from faultline.operators.commits import score_commits
from faultline.plans.commits import SCORED
from faultline.plans.registry import query

ROW = ["repo", "file_path", "commit_id"]


def rounded(df, digits=8):
    """Doubles rounded for value comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def curve_sql(source, keys, p):
    """CTEs `pts` (points with running counts) and `tot` for AP and ROC in window form."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    return f"""cnt AS (SELECT {k + ', ' if keys else ''}{p} AS p, sum(y)::BIGINT AS pos, count(*) AS n FROM {source} GROUP BY ALL),
pts AS (SELECT *, sum(pos) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS c,
  sum(pos) OVER ({part}) AS pp, sum(n) OVER ({part}) AS nn FROM cnt WINDOW w AS ({part} ORDER BY p DESC))"""


AP = "sum(CASE WHEN pp > 0 THEN pos / pp::DOUBLE ELSE 0e0 END * tp / c::DOUBLE)"
ROC = "sum((n - pos) * (tp - pos / 2e0)) / max(pp * (nn - pp))"


@query("average_precision", "PR", f"WITH {curve_sql('pr_predictions', ['repo'], 'p_full')} SELECT repo, round({AP}, 8) AS pr_auc FROM pts GROUP BY repo")
def average_precision(pr):
    return rounded(op.average_precision(pr, ["repo"], p="p_full"))


@query("average_precision_pooled", "PR", f"WITH {curve_sql('pr_predictions', [], 'p_full')} SELECT round({AP}, 8) AS pr_auc FROM pts")
def average_precision_pooled(pr):
    return rounded(op.average_precision(pr, [], p="p_full"))


@query(
    "roc_auc", "PR",
    """SELECT repo, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 8) AS roc_auc FROM (
  SELECT repo, y, rank() OVER (PARTITION BY repo ORDER BY p_full) + (count(*) OVER (PARTITION BY repo, p_full) - 1) / 2e0 AS r FROM pr_predictions) GROUP BY repo""",
)
def roc_auc(pr):
    return rounded(op.roc_auc(pr, ["repo"], p="p_full"))


@query(
    "threshold_metrics", "PR",
    """WITH t AS (SELECT repo, count(*) FILTER (p_full >= 0.5 AND y = 1) AS tp, count(*) FILTER (p_full >= 0.5 AND y = 0) AS fp, count(*) FILTER (p_full < 0.5 AND y = 1) AS fn,
  count(*) FILTER (p_full < 0.5 AND y = 0) AS tn FROM pr_predictions GROUP BY repo)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM t""",
)
def threshold_metrics(pr):
    return op.threshold_metrics(pr, ["repo"], p="p_full")


@query("brier", "PR", "SELECT repo, round(avg((p_full - y) * (p_full - y)), 8) AS brier FROM pr_predictions GROUP BY repo")
def brier(pr):
    return rounded(op.brier(pr, ["repo"], p="p_full"))


BINS = "b AS (SELECT repo, least(floor(p_full * 10), 9)::INT AS bin, count(*) AS rows, avg(p_full) AS mean_predicted, avg(y) AS observed_rate FROM pr_predictions GROUP BY 1, 2)"


@query("calibration_bins", "PR", f"WITH {BINS} SELECT repo, bin, rows, round(mean_predicted, 12) AS mean_predicted, round(observed_rate, 12) AS observed_rate FROM b")
def calibration_bins(pr):
    return rounded(op.calibration_bins(pr, ["repo"], p="p_full"), 12)


@query("ece", "PR", f"WITH {BINS} SELECT repo, round(sum(abs(observed_rate - mean_predicted) * rows) / sum(rows), 8) AS ece FROM b GROUP BY repo")
def ece(pr):
    return rounded(op.expected_calibration_error(pr, ["repo"], p="p_full"))


def evaluation_sql(source, p, name):
    """CTE `name`: per-repository and pooled evaluation of score p; needs columns repo, y and p."""
    return f"""{name}_s AS (SELECT repo, y, {p} AS p FROM {source} UNION ALL SELECT '(pooled)', y, {p} FROM {source}),
{name}_c AS (SELECT repo, p, sum(y)::BIGINT AS pos, count(*) AS n FROM {name}_s GROUP BY ALL),
{name}_p AS (SELECT *, sum(pos) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS c,
  sum(pos) OVER (PARTITION BY repo) AS pp, sum(n) OVER (PARTITION BY repo) AS nn FROM {name}_c WINDOW w AS (PARTITION BY repo ORDER BY p DESC)),
{name}_a AS (SELECT repo, max(nn)::BIGINT AS n_rows, max(pp)::BIGINT AS n_pos, {AP} AS ap, {ROC} AS roc,
  sum(pos * (p - 1) * (p - 1) + (n - pos) * p * p) / max(nn)::DOUBLE AS brier, greatest(1, floor(max(nn)::DOUBLE * 0.2::DOUBLE)) AS k,
  sum(pos * greatest(0e0, least(1e0, (greatest(1, floor(nn::DOUBLE * 0.2::DOUBLE)) - (c - n)) / n::DOUBLE))) AS caught FROM {name}_p GROUP BY repo),
{name} AS (SELECT repo, n_rows, n_pos, n_rows - n_pos AS n_neg, n_pos / n_rows * 100 AS prevalence, ap AS pr_auc, roc AS roc_auc, brier,
  ap - n_pos / n_rows AS lift, caught / k * 100 AS prec_at_20, caught / n_pos * 100 AS rec_at_20 FROM {name}_a)"""


METRICS = "prevalence pr_auc roc_auc brier lift prec_at_20 rec_at_20".split()


@query(
    "repo_evaluation", "PR",
    f"WITH {evaluation_sql('pr_predictions', 'p_full', 'ev')} SELECT repo, n_rows, n_pos, n_neg, "
    + ", ".join(f"round({m}, 8) AS {m}" for m in METRICS) + " FROM ev",
)
def repo_evaluation(pr):
    return rounded(op.repo_evaluation(pr, p="p_full"))


@query(
    "top_share", "PR",
    """WITH p AS (SELECT repo, file_path, commit_id, p_full, row_number() OVER (ORDER BY p_full DESC, md5(concat(repo, '|', file_path, '|', commit_id)), repo, file_path, commit_id) AS pos, count(*) OVER () AS n FROM pr_predictions)
SELECT repo, file_path, commit_id, p_full FROM p WHERE pos <= greatest(1, floor(n * 0.2::DOUBLE))""",
)
def top_share(pr):
    return op.top_share(pr.select(*ROW, "p_full"), ROW, "p_full")


@query(
    "hybrid_scores", "PR",
    """SELECT repo, file_path, commit_id, CASE WHEN h % 2 = 1 THEN 'full' ELSE 'static' END AS engine, CASE WHEN h % 2 = 1 THEN p_full ELSE p_static END AS p
FROM (SELECT *, ('0x' || substring(md5(concat('42|', repo, '|', file_path, '|', commit_id)), 1, 4))::INT AS h FROM pr_predictions)""",
)
def hybrid_scores(pr):
    return op.hybrid_scores(pr, ROW).select(*ROW, "engine", "p")


@query(
    "release_gates", "PR",
    f"""WITH ood AS (SELECT * FROM pr_predictions WHERE repo IN ('repo6', 'repo7')), pool AS (SELECT * FROM pr_predictions WHERE repo NOT IN ('repo6', 'repo7')),
{evaluation_sql('ood', 'p_full', 'fo')}, {evaluation_sql('ood', 'p_static', 'so')}, {evaluation_sql('pool', 'p_static', 'sp')},
v AS (SELECT (SELECT brier FROM fo WHERE repo = '(pooled)') AS b, (SELECT min(p_full) FROM ood) AS lo, (SELECT max(p_full) FROM ood) AS hi,
  (SELECT avg(roc_auc) FROM sp WHERE repo <> '(pooled)') AS lr, (SELECT avg(lift) FROM sp WHERE repo <> '(pooled)') AS ll, (SELECT roc_auc FROM so WHERE repo = '(pooled)') AS r)
SELECT 'ood_brier' AS gate, round(b, 8) AS value, b <= 0.25 AS passed FROM v UNION ALL SELECT 'probability_tails', round(hi - lo, 8), lo > 0.001 AND hi < 0.999 FROM v
UNION ALL SELECT 'lopo_roc_auc', round(lr, 8), lr >= 0.65 FROM v UNION ALL SELECT 'lopo_lift', round(ll, 8), ll >= 0.08 FROM v UNION ALL SELECT 'ood_roc_auc', round(r, 8), r >= 0.65 FROM v""",
)
def release_gates(pr):
    ood = pr.where("repo IN ('repo6', 'repo7')")
    pool = pr.where("repo NOT IN ('repo6', 'repo7')")
    pooled = F.col("repo") == "(pooled)"
    return rounded(
        op.release_gates(
            op.repo_evaluation(ood, p="p_full").where(pooled),
            op.repo_evaluation(pool, p="p_static").where(~pooled),
            op.repo_evaluation(ood, p="p_static").where(pooled),
            ood,
        )
    )


# Fold results of four feature groups in two regimes, from blends of the two scores.
BLENDS = {"A": "p_static", "B": "(p_full + p_static) / 2e0", "C": "p_full", "D": "(p_full * 3e0 + p_static) / 4e0"}
RES = f"""blend AS (SELECT p.*, CASE WHEN commit_id % 3 = 0 THEN 'logreg' ELSE 'forest' END AS model, commit_id % 9 AS fold_no FROM pr_predictions p),
long AS ({' UNION ALL '.join(f"SELECT model, repo, fold_no, y, '{g}' AS feature_group, {e} AS p FROM blend" for g, e in BLENDS.items())}),
runs AS (SELECT model, feature_group, 'lopo' AS regime, repo AS key, y, p FROM long UNION ALL SELECT model, feature_group, 'temporal_cv', concat('fold', fold_no), y, p FROM long),
{curve_sql('runs', ['model', 'feature_group', 'regime', 'key'], 'p')},
res AS (SELECT model, feature_group, regime, key, {AP} AS pr_auc, {ROC} AS roc_auc,
  2 * sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) / (sum(CASE WHEN p >= 0.5 THEN n ELSE 0 END) + max(pp)) AS f1,
  sum(pos * (p - 1) * (p - 1) + (n - pos) * p * p) / max(nn)::DOUBLE AS brier_score FROM pts GROUP BY ALL)"""


def results_of(pr):
    blend = pr.select(
        "repo", "y", (F.col("commit_id") % 9).alias("fold_no"), F.when(F.col("commit_id") % 3 == 0, "logreg").otherwise("forest").alias("model"),
        F.inline(F.array(*[F.struct(F.lit(g).alias("feature_group"), F.expr(e).alias("p")) for g, e in BLENDS.items()])),
    )
    runs = blend.select(
        "model", "feature_group", "y", "p",
        F.inline(F.array(
            F.struct(F.lit("lopo").alias("regime"), F.col("repo").alias("key")),
            F.struct(F.lit("temporal_cv").alias("regime"), F.concat(F.lit("fold"), F.col("fold_no").cast("string")).alias("key")),
        )),
    )
    return op.fold_metrics(runs, ["model", "feature_group", "regime", "key"])


@query(
    "fold_metrics", "PR",
    f"WITH {RES} SELECT model, feature_group, regime, key, round(pr_auc, 8) AS pr_auc, round(roc_auc, 8) AS roc_auc, round(f1, 8) AS f1, round(brier_score, 8) AS brier_score FROM res",
)
def fold_metrics(pr):
    return rounded(results_of(pr)).select("model", "feature_group", "regime", "key", "pr_auc", "roc_auc", "f1", "brier_score")


@query(
    "results_table", "PR",
    f"""WITH {RES} SELECT regime, model, feature_group, round(avg(pr_auc), 8) AS mean_pr_auc, round(stddev_samp(pr_auc), 8) AS std_pr_auc, round(avg(roc_auc), 8) AS mean_roc_auc,
  round(avg(f1), 8) AS mean_f1, round(avg(brier_score), 8) AS mean_brier, count(*) AS folds FROM res GROUP BY 1, 2, 3""",
)
def results_table(pr):
    return rounded(op.results_table(results_of(pr)))


@query(
    "fold_ci", "PR",
    f"""WITH {RES} SELECT regime, model, feature_group, round(avg(pr_auc), 8) AS mean_pr_auc, round(stddev_pop(pr_auc), 8) AS std_pr_auc, round(quantile_cont(pr_auc, 0.025), 8) AS ci_lower,
  round(quantile_cont(pr_auc, 0.975), 8) AS ci_upper, count(*) AS n_evaluations FROM res GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def fold_ci(pr):
    return rounded(op.fold_ci(results_of(pr)))


@query(
    "best_config", "PR",
    f"WITH {RES} SELECT model, feature_group, round(avg(pr_auc), 8) AS mean_pr_auc FROM res GROUP BY 1, 2 ORDER BY avg(pr_auc) DESC LIMIT 1",
)
def best_config(pr):
    return rounded(op.best_config(results_of(pr)))


@query(
    "paired_scores", "PR",
    f"""WITH {evaluation_sql('pr_predictions', 'p_full', 'fe')}, {evaluation_sql('pr_predictions', 'p_static', 'se')}
SELECT repo, round(fe.pr_auc, 8) AS pr_auc_full, round(se.pr_auc, 8) AS pr_auc_static FROM fe JOIN se USING (repo)""",
)
def paired_scores(pr):
    full, static = op.repo_evaluation(pr, p="p_full"), op.repo_evaluation(pr, p="p_static")
    return rounded(op.paired_scores(full, static, ["repo"], suffixes=("_full", "_static")))


SIGN = """pairs AS (SELECT a.regime, a.model, concat(c.x, ' vs ', c.z) AS comparison, a.key, a.pr_auc AS sa, b.pr_auc AS sb
  FROM (VALUES ('D', 'C'), ('C', 'A'), ('C', 'B')) c(x, z) JOIN res a ON a.feature_group = c.x JOIN res b ON b.feature_group = c.z AND a.regime = b.regime AND a.model = b.model AND a.key = b.key),
eff AS (SELECT regime, model, comparison, count(*) AS n_pairs, avg(sa) - avg(sb) AS diff, (avg(sa) - avg(sb)) / sqrt((var_pop(sa) + var_pop(sb)) / 2) AS d FROM pairs GROUP BY 1, 2, 3)"""


@query(
    "significance_grid", "PR",
    f"""WITH {RES}, {SIGN} SELECT regime, model, comparison, n_pairs, round(diff, 8) AS observed_diff, round(d, 8) AS cohens_d,
  CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_magnitude FROM eff WHERE n_pairs >= 3""",
)
def significance_grid(pr):
    return rounded(op.significance_grid(results_of(pr)))


@query(
    "sign_flip_test", "PR",
    f"""WITH {RES}, {SIGN},
flips AS (SELECT regime, model, comparison, rep, avg((sa - sb) * CASE WHEN substr(md5(concat('42|', rep, '|', key)), 1, 1) < '8' THEN -1 ELSE 1 END) AS m
  FROM pairs, range(1, 2001) r(rep) GROUP BY ALL)
SELECT regime, model, comparison, any_value(n_pairs) AS n_pairs, round(any_value(diff), 8) AS observed_diff, round(any_value(d), 8) AS cohens_d,
  any_value(CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END) AS effect_magnitude,
  avg((abs(m) >= abs(diff) - 1e-12::DOUBLE)::INT) AS p_value, avg((abs(m) >= abs(diff) - 1e-12::DOUBLE)::INT) < 0.05 AS significant_at_0_05, 'two-sided' AS alternative
FROM flips JOIN eff USING (regime, model, comparison) GROUP BY 1, 2, 3""",
)
def sign_flip_test(pr):
    return rounded(op.sign_flip_test(op.group_pairs(results_of(pr)), ["regime", "model", "comparison"], "key"))


RESAMPLED = """pts AS (SELECT p_full AS p, sum(y)::BIGINT AS pos, count(*) AS n, row_number() OVER (ORDER BY p_full DESC) AS position FROM pr_predictions GROUP BY 1),
kinds AS (SELECT position, 'pos' AS kind, pos AS mean FROM pts UNION ALL SELECT position, 'neg', n - pos FROM pts),
ks AS (SELECT mean, k, exp(-mean + k * ln(mean) - sum(ln(greatest(k, 1))) OVER (PARTITION BY mean ORDER BY k)) AS pmf
  FROM (SELECT DISTINCT mean FROM kinds WHERE mean > 0), LATERAL (SELECT unnest(range(0, CAST(floor(mean + 12 * sqrt(mean)) AS BIGINT) + 31)) AS k)),
cdf AS (SELECT mean, k, coalesce(sum(pmf) OVER (PARTITION BY mean ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM ks),
draws AS (SELECT position, kind, mean, rep, ('0x' || substr(md5(concat('42|', rep, '|', kind, '|', position)), 1, 13))::BIGINT / 4503599627370496e0 AS u
  FROM kinds, range(1, 2001) r(rep) WHERE mean > 0),
drawn AS (SELECT rep, position, coalesce(sum(k) FILTER (kind = 'pos'), 0) AS pos, sum(k) AS n FROM draws ASOF JOIN cdf ON draws.mean = cdf.mean AND draws.u >= cdf.low GROUP BY 1, 2),
placed AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS c FROM drawn WINDOW w AS (PARTITION BY rep ORDER BY position)),
reps AS (SELECT rep, sum(CASE WHEN c > 0 THEN pos * tp / c::DOUBLE ELSE 0 END) / sum(pos) AS ap FROM placed GROUP BY 1 HAVING sum(pos) > 0 AND sum(pos) < sum(n))"""


@query(
    "bootstrap_ci", "PR",
    f"""WITH {RESAMPLED}, {curve_sql('(SELECT p_full, y FROM pr_predictions)', [], 'p_full')
        .replace('pts AS', 'curve AS')}
SELECT (SELECT round({AP}, 8) FROM curve) AS point_estimate, round(quantile_cont(ap, 0.025), 8) AS lower, round(quantile_cont(ap, 0.975), 8) AS upper,
  round(stddev_pop(ap), 8) AS std_error, count(*) AS n_bootstrap, 'percentile' AS method FROM reps""",
)
def bootstrap_ci(pr):
    """Percentile interval of the pooled average precision."""
    return rounded(op.bootstrap_ci(pr, p="p_full", method="percentile"))


@query("bootstrap_bca", "PR")
def bootstrap_bca(pr):
    """The same with bias correction and acceleration, which need the normal distribution's inverse; no check SQL."""
    return op.bootstrap_ci(pr, p="p_full")


KAPPA = """t AS (SELECT count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a AND NOT b) AS tn, count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn, count(*) AS n FROM ab),
k AS (SELECT *, (tp + tn) / n AS po, (tp + fn) / n * ((tp + fp) / n) + (fp + tn) / n * ((fn + tn) / n) AS pe FROM t),
kk AS (SELECT *, CASE WHEN pe = 1 THEN 1e0 ELSE (po - pe) / (1 - pe) END AS kappa FROM k),
kl AS (SELECT *, CASE WHEN kappa < 0 THEN 'Poor (below chance)' WHEN kappa < 0.2 THEN 'Slight' WHEN kappa < 0.4 THEN 'Fair' WHEN kappa < 0.6 THEN 'Moderate' WHEN kappa < 0.8 THEN 'Substantial' ELSE 'Almost perfect' END AS interpretation FROM kk)"""
AB = f"{SCORED}, ab AS (SELECT s.is_bug_fix AS a, n.human_label AS b FROM scored s JOIN an_annotations n USING (commit_id))"


def labelled(c, an):
    return score_commits(c).select("commit_id", "is_bug_fix").join(an.select("commit_id", "human_label"), "commit_id")


@query(
    "cohens_kappa", "C AN",
    f"{AB}, {KAPPA} SELECT tp, tn, fp, fn, n, round(po, 8) AS po, round(pe, 8) AS pe, round(kappa, 8) AS kappa, interpretation FROM kl",
)
def cohens_kappa(c, an):
    return rounded(op.cohens_kappa(labelled(c, an), "is_bug_fix", "human_label"))


@query(
    "agreement_metrics", "C AN",
    f"""{AB}, {KAPPA} SELECT round(tp / (tp + fn), 8) AS precision, round(tp / (tp + fp), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, tp, fn AS fp, fp AS fn,
  tp + fp AS n_positive_human, tp + fn AS n_positive_heuristic, round(kappa, 8) AS kappa, interpretation AS kappa_interpretation, n AS support FROM kl""",
)
def agreement_metrics(c, an):
    return rounded(op.agreement_metrics(labelled(c, an), "is_bug_fix", "human_label"))


@query(
    "lift_vs_prevalence", "PR",
    f"""WITH {evaluation_sql('pr_predictions', 'p_full', 'ev')} SELECT round(regr_slope(lift, prevalence), 6) AS slope, round(regr_intercept(lift, prevalence), 6) AS intercept,
  round(corr(lift, prevalence), 6) AS r, count(*) AS repos FROM ev WHERE repo <> '(pooled)'""",
)
def lift_vs_prevalence(pr):
    per_repo = op.repo_evaluation(pr, p="p_full").where("repo <> '(pooled)'")
    return rounded(op.lift_vs_prevalence(per_repo), 6)


@query(
    "retention", "PR",
    f"""WITH {evaluation_sql('pr_predictions', 'p_full', 'fe')}, {evaluation_sql('pr_predictions', 'p_static', 'se')},
v AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, (SELECT avg({m}) FROM fe WHERE repo <> '(pooled)') AS a, (SELECT avg({m}) FROM se WHERE repo <> '(pooled)') AS b" for m in ("pr_auc", "roc_auc", "lift"))})
SELECT metric, round(a, 8) AS full_engine, round(b, 8) AS static_engine, round(b / a * 100, 8) AS retention_pct FROM v""",
)
def retention(pr):
    keep = "repo <> '(pooled)'"
    return rounded(op.retention(op.repo_evaluation(pr, p="p_full").where(keep), op.repo_evaluation(pr, p="p_static").where(keep)))


@query(
    "lopo_topn", "PR",
    f"""WITH {evaluation_sql('pr_predictions', 'p_full', 'ev')} SELECT repo, round(pr_auc, 8) AS pr_auc, round((SELECT avg(pr_auc) FROM ev WHERE repo <> '(pooled)'), 8) AS mean_pr_auc
FROM ev WHERE repo <> '(pooled)' ORDER BY ev.pr_auc DESC, repo LIMIT 5""",
)
def lopo_topn(pr):
    per_repo = op.repo_evaluation(pr, p="p_full").where("repo <> '(pooled)'").select("repo", "pr_auc")
    return rounded(op.top_results(per_repo, "pr_auc", 5))
