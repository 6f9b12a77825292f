"""Registered queries on derived features."""

from pyspark.sql import functions as F

from faultline.operators import features as op
from faultline.operators.history import file_history
from faultline.operators.commits import score_commits
from faultline.plans.history import FCS, written_changes
from faultline.plans.registry import query
from faultline.session import materialize

ROW = ["repo", "file_path", "commit_id"]


@query(
    "trajectory", "SN",
    """SELECT repo, file_path, commit_id, coalesce(d, 0) AS smell_delta, coalesce(c, 0) AS complexity_delta, sign(coalesce(d, 0))::INT AS smell_trend,
  (coalesce(d, 0) > 0)::INT AS has_smell_increase, total_smells / greatest(code_loc, 1) AS smell_density FROM (
SELECT *, total_smells - lag(total_smells) OVER w AS d, code_max_cyclomatic_complexity - lag(code_max_cyclomatic_complexity) OVER w AS c
FROM sn_snapshots WINDOW w AS (PARTITION BY repo, file_path ORDER BY commit_date, commit_id))""",
)
def trajectory(sn):
    return op.trajectory(sn).select(*ROW, *op.TRAJECTORY)


FLAGS = ["has_large_class", "has_high_complexity", "has_deep_nesting"]


def _age_sql():
    lag = ", ".join(f"{f} = 1 AND coalesce(lag({f}) OVER w, 0) = 0 AS b_{f}" for f in FLAGS)
    since = ", ".join(f"max(commit_date) FILTER (b_{f}) OVER w AS s_{f}" for f in FLAGS)
    age = ", ".join(
        f"CASE WHEN {f} = 1 THEN (epoch(commit_date) - epoch(s_{f})) / 86400e0 ELSE 0e0 END AS age_{f}" for f in FLAGS
    )
    names = [f"age_{f}" for f in FLAGS]
    persistent = " + ".join(f"({n} >= 90)::INT" for n in names)
    w = "WINDOW w AS (PARTITION BY repo, file_path ORDER BY commit_date, commit_id)"
    return f"""WITH a AS (SELECT *, {lag} FROM sn_snapshots {w}), b AS (SELECT *, {since} FROM a {w}),
c AS (SELECT repo, file_path, commit_id, {age} FROM b)
SELECT *, greatest({', '.join(names)}) AS max_smell_age_days, {' + '.join(names)} AS total_smell_age_days,
  {persistent} AS persistent_smell_count, ({persistent} > 0)::INT AS has_persistent_smell FROM c"""


@query("smell_age", "SN", _age_sql())
def smell_age(sn):
    return op.smell_age(sn, FLAGS).select(
        *ROW, *[f"age_{f}" for f in FLAGS], "max_smell_age_days", "total_smell_age_days", "persistent_smell_count", "has_persistent_smell"
    )


CAUSAL = ["code_loc", "code_max_cyclomatic_complexity", "total_smells", "smell_density"]


@query(
    "causal_rank", "SN",
    """WITH s AS (SELECT *, total_smells / greatest(code_loc, 1) AS smell_density FROM sn_snapshots),
j AS (SELECT a.repo, a.file_path, a.commit_id, count(*)::DOUBLE AS n, """
    + ", ".join(f"count(*) FILTER (b.{c} <= a.{c}) AS n_{c}" for c in CAUSAL)
    + """ FROM s a JOIN s b ON a.repo = b.repo AND b.commit_date <= a.commit_date GROUP BY 1, 2, 3)
SELECT repo, file_path, commit_id, """
    + ", ".join(f"n_{c} / n AS rank_{c}" for c in CAUSAL)
    + " FROM j",
)
def causal_rank(sn):
    dense = sn.withColumn("smell_density", op.smell_density()).select(*ROW, "commit_date", *CAUSAL)
    return op.causal_rank(dense, CAUSAL).select(*ROW, *[f"rank_{c}" for c in CAUSAL])


@query(
    "repo_relative", "SN",
    """WITH s AS (SELECT *, total_smells / greatest(code_loc, 1) AS smell_density FROM sn_snapshots),
m AS (SELECT repo, """
    + ", ".join(f"quantile_cont({c}::DOUBLE, 0.5) AS m_{c}" for c in CAUSAL)
    + """ FROM s GROUP BY repo)
SELECT s.repo, file_path, commit_id, """
    + ", ".join(f"CASE WHEN m_{c} = 0 THEN 0e0 ELSE {c} / m_{c} END AS rel_{c}" for c in CAUSAL)
    + " FROM s JOIN m USING (repo)",
)
def repo_relative(sn):
    dense = sn.withColumn("smell_density", op.smell_density())
    return op.repo_relative(dense, CAUSAL).select(*ROW, *[f"rel_{c}" for c in CAUSAL])


PROBS = "[" + ", ".join(f"{i / 100!r}" for i in range(101)) + "]"
QUANTILES = f"""u AS (UNPIVOT (SELECT code_loc::DOUBLE AS code_loc, code_max_cyclomatic_complexity::DOUBLE AS code_max_cyclomatic_complexity,
  total_smells::DOUBLE AS total_smells FROM sn_snapshots) ON code_loc, code_max_cyclomatic_complexity, total_smells INTO NAME feature VALUE x),
q AS (SELECT feature, unnest(range(101))::INT AS idx, unnest(quantile_cont(x, {PROBS})) AS value FROM u GROUP BY feature)"""
TABLED = ["code_loc", "code_max_cyclomatic_complexity", "total_smells"]


@query("quantile_reference", "SN", f"WITH {QUANTILES} SELECT feature, idx, round(value, 8) AS value FROM q")
def quantile_reference(sn):
    return op.quantile_reference(sn, TABLED).withColumn("value", F.round("value", 8))


@query(
    "quantile_rank", "SN",
    f"""WITH {QUANTILES},
t AS (SELECT feature, list(value ORDER BY idx) AS xs FROM q GROUP BY feature),
d AS (SELECT repo, file_path, commit_id, code_loc * 1.25e0 - 60 AS x, len(list_filter(xs, lambda k: k <= code_loc * 1.25e0 - 60)) AS i, xs FROM sn_snapshots, t WHERE feature = 'code_loc')
SELECT repo, file_path, commit_id, 0.5::DOUBLE AS qrank_unknown, round(CASE WHEN i = 0 THEN 0.01::DOUBLE WHEN i >= 101 THEN 0.99::DOUBLE
  ELSE 0.01::DOUBLE + 0.0098::DOUBLE * (i - 1) + 0.0098::DOUBLE * (x - xs[i]) / (xs[i + 1] - xs[i]) END, 8) AS qrank_code_loc FROM d""",
)
def quantile_rank(sn):
    table = op.quantile_reference(sn, TABLED)
    probes = sn.select(*ROW, (F.col("code_loc") * 1.25 - 60).alias("code_loc"), F.lit(1.0).alias("unknown"))
    return op.quantile_rank(probes, ["code_loc", "unknown"], table).select(
        *ROW, "qrank_unknown", F.round("qrank_code_loc", 8).alias("qrank_code_loc")
    )


PAIRS = """m AS (SELECT DISTINCT repo, commit_id, file_path FROM sn_snapshots),
p AS (SELECT a.repo, a.file_path, a.commit_id, b.file_path AS peer FROM m a LEFT JOIN m b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.file_path <> b.file_path),
t AS (SELECT repo, file_path, count(DISTINCT commit_id) AS commits, count(peer) AS co_changes, count(DISTINCT peer) AS distinct_peers,
  count(DISTINCT CASE WHEN peer IS NOT NULL THEN commit_id END) AS coupled FROM p GROUP BY 1, 2)"""


@query("cochange_pairs", "SN", f"WITH {PAIRS} SELECT repo, file_path, commits, co_changes, coupled AS coupled_commits, distinct_peers FROM t")
def cochange_pairs(sn):
    """Per file the number of co-change pairs and of distinct partners; pairs themselves are not listed."""
    return op.cochange_totals(sn).select(*op.FILE, "commits", "co_changes", "coupled_commits", "distinct_peers")


@query(
    "cochange_features", "SN",
    f"""WITH {PAIRS},
v AS (SELECT p.repo, p.file_path, coalesce(avg(s.code_max_cyclomatic_complexity), 0) AS cc, coalesce(avg(s.code_loc), 0) AS loc
  FROM p LEFT JOIN sn_snapshots s ON p.repo = s.repo AND p.commit_id = s.commit_id AND p.peer = s.file_path GROUP BY 1, 2)
SELECT repo, file_path, distinct_peers AS cochange_peer_count, coupled / commits AS cochange_coupling_ratio, round(cc, 8) AS cochange_peer_complexity_mean,
  round(loc, 8) AS cochange_peer_loc_mean, cume_dist() OVER (PARTITION BY repo ORDER BY distinct_peers) AS rank_cochange_peer_count,
  distinct_peers + 1 AS cochange_cluster_size FROM t JOIN v USING (repo, file_path)""",
)
def cochange_features(sn):
    out = op.cochange_features(sn)
    return out.withColumn("cochange_peer_complexity_mean", F.round("cochange_peer_complexity_mean", 8)).withColumn(
        "cochange_peer_loc_mean", F.round("cochange_peer_loc_mean", 8)
    )


HIST = """h AS (SELECT a.repo, a.file_path, a.commit_id, count(b.commit_id) AS commits, count(*) FILTER (b.is_bug_fix) AS fixes, count(DISTINCT b.author) AS authors,
  count(*) FILTER (b.commit_date >= a.commit_date - INTERVAL 30 DAY) AS recent, coalesce((epoch(any_value(a.commit_date)) - epoch(min(b.commit_date))) / 86400e0, 0) AS age
  FROM scored a LEFT JOIN scored b ON a.repo = b.repo AND a.file_path = b.file_path AND b.commit_date < a.commit_date GROUP BY 1, 2, 3),
tp AS (SELECT repo, file_path, commit_id, max(c) AS top FROM (SELECT a.repo, a.file_path, a.commit_id, b.author, count(*) AS c FROM scored a JOIN scored b
  ON a.repo = b.repo AND a.file_path = b.file_path AND b.commit_date < a.commit_date GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""


def with_history(sn, fc):
    changes = written_changes(fc)
    history = file_history(changes, changes.select(*ROW, "commit_date")).drop("commit_date")
    return sn.join(history, ROW)


@query(
    "interactions", "SN FC",
    f"""{FCS}, {HIST}
SELECT s.repo, s.file_path, s.commit_id, total_smells * commits AS smells_x_churn, total_smells * fixes AS smells_x_bugs, code_max_cyclomatic_complexity * recent AS complexity_x_churn,
  round(total_smells / greatest(code_loc, 1) * age, 8) AS smells_x_age, round(CASE WHEN commits = 0 THEN 0e0 ELSE fixes / commits END * total_smells, 8) AS bug_rate_x_smells
FROM sn_snapshots s JOIN h USING (repo, file_path, commit_id)""",
)
def interactions(sn, fc):
    out = op.interactions(with_history(sn, fc)).select(*ROW, *op.INTERACTION)
    return out.withColumn("smells_x_age", F.round("smells_x_age", 8)).withColumn("bug_rate_x_smells", F.round("bug_rate_x_smells", 8))


@query(
    "ownership_features", "SN FC",
    f"""{FCS}, {HIST}
SELECT s.repo, s.file_path, s.commit_id, round(CASE WHEN authors = 0 THEN 0e0 ELSE coalesce(top, 0) / commits / authors END, 8) AS silo_index,
  round(authors * 365e0 / greatest(age, 1e0), 8) AS contributor_annual_rate, code_max_cyclomatic_complexity * commits AS complexity_churn_interaction
FROM sn_snapshots s JOIN h USING (repo, file_path, commit_id) LEFT JOIN tp USING (repo, file_path, commit_id)""",
)
def ownership_features(sn, fc):
    out = op.ownership_features(with_history(sn, fc))
    return out.select(
        *ROW, F.round("silo_index", 8).alias("silo_index"),
        F.round("contributor_annual_rate", 8).alias("contributor_annual_rate"), "complexity_churn_interaction",
    )


OWNED = ["contributor_annual_rate", "complexity_churn_interaction"]


@query(
    "ownership_ranks", "SN FC",
    f"""{FCS}, {HIST},
o AS (SELECT s.repo, s.file_path, s.commit_id, s.commit_date, authors * 365e0 / greatest(age, 1e0) AS contributor_annual_rate, code_max_cyclomatic_complexity * commits AS complexity_churn_interaction
  FROM sn_snapshots s JOIN h USING (repo, file_path, commit_id))
SELECT a.repo, a.file_path, a.commit_id, """
    + ", ".join(f"count(*) FILTER (b.{c} <= a.{c}) / count(*)::DOUBLE AS rank_{c}" for c in OWNED)
    + " FROM o a JOIN o b ON a.repo = b.repo AND b.commit_date <= a.commit_date GROUP BY 1, 2, 3",
)
def ownership_ranks(sn, fc):
    """Ranks of the ownership columns among the repository's snapshots so far."""
    owned = materialize(op.ownership_features(with_history(sn, fc)).select(*ROW, "commit_date", *OWNED), "owned")
    return op.causal_rank(owned, OWNED).select(*ROW, *[f"rank_{c}" for c in OWNED])


@query(
    "feature_project", "SN",
    "SELECT repo, file_path, commit_id, code_loc, code_max_cyclomatic_complexity, has_large_class, has_deep_nesting, has_high_complexity FROM sn_snapshots",
)
def feature_project(sn):
    from faultline.operators.snapshots import project_features

    return project_features(sn, op.GROUPS["C"], removed=["total_smells", "code_max_nesting_depth"], keep=ROW)


STATIC_TABLED = ["code_loc", "code_max_cyclomatic_complexity", "total_smells", "smell_density"]


def _static_sql():
    have = {
        "code_loc", "code_max_cyclomatic_complexity", "code_max_nesting_depth", "has_large_class", "has_deep_nesting",
        "has_high_complexity", "total_smells", "smell_density",
    }

    def ranked(c):
        x, i = f"t_{c}", f"len(list_filter(t_{c}, lambda k: k <= {c}))"
        inside = f"0.01::DOUBLE + 0.0098::DOUBLE * ({i} - 1) + 0.0098::DOUBLE * ({c} - {x}[{i}]) / ({x}[{i} + 1] - {x}[{i}])"
        return f"round(CASE WHEN {i} = 0 THEN 0.01::DOUBLE WHEN {i} >= 101 THEN 0.99::DOUBLE ELSE {inside} END, 8) AS rank_{c}"

    out = []
    for f in op.STATIC_FEATURES:
        if f in have:
            out.append(f"{f}::DOUBLE AS {f}")
        elif f.startswith("rank_"):
            out.append(ranked(f[5:]) if f[5:] in have else f"0.5::DOUBLE AS {f}")
        else:
            out.append(f"0e0 AS {f}")
    tables = ", ".join(f"(SELECT quantile_cont({c}::DOUBLE, {PROBS}) FROM s) AS t_{c}" for c in STATIC_TABLED)
    return f"""WITH s AS (SELECT *, total_smells / greatest(code_loc, 1) AS smell_density FROM sn_snapshots), d AS (SELECT s.*, {tables} FROM s)
SELECT repo, file_path, commit_id, {', '.join(out)} FROM d"""


@query("static_feature_row", "SN", _static_sql())
def static_feature_row(sn):
    """The 34 static features; every ranked one that the snapshots have goes through its quantile table."""
    dense = sn.withColumn("smell_density", op.smell_density())
    ranked = op.quantile_rank(dense, STATIC_TABLED, op.quantile_reference(dense, STATIC_TABLED))
    row = op.feature_row(ranked, op.STATIC_FEATURES, ROW)
    return row.withColumns({f"rank_{c}": F.round(f"rank_{c}", 8) for c in STATIC_TABLED})


FULL = ["code_loc", "total_smells", "previous_file_commits", "previous_bug_fixes", "contributors", "recent_file_commits",
        "file_age_days", "smells_x_churn", "complexity_x_churn", "rel_code_loc", "silo_index", "is_missing"]


@query(
    "full_feature_row", "SN FC",
    f"""{FCS}, {HIST}
SELECT s.repo, s.file_path, s.commit_id, code_loc::DOUBLE AS code_loc, total_smells::DOUBLE AS total_smells, commits::DOUBLE AS previous_file_commits,
  fixes::DOUBLE AS previous_bug_fixes, authors::DOUBLE AS contributors, recent::DOUBLE AS recent_file_commits, age AS file_age_days,
  (total_smells * commits)::DOUBLE AS smells_x_churn, (code_max_cyclomatic_complexity * recent)::DOUBLE AS complexity_x_churn,
  code_loc::DOUBLE AS rel_code_loc, round(CASE WHEN authors = 0 THEN 0e0 ELSE coalesce(top, 0) / commits / authors END, 8) AS silo_index, 0e0 AS is_missing
FROM sn_snapshots s JOIN h USING (repo, file_path, commit_id) LEFT JOIN tp USING (repo, file_path, commit_id)""",
)
def full_feature_row(sn, fc):
    enriched = op.ownership_features(op.interactions(with_history(sn, fc)))
    return op.feature_row(enriched, FULL, ROW).withColumn("silo_index", F.round("silo_index", 8))


@query(
    "telemetry_left_join", "SN FC",
    f"""{FCS}, a AS (SELECT repo, file_path, count(*) AS n, count(*) FILTER (is_bug_fix) AS fixes, count(DISTINCT author) AS authors FROM scored WHERE lines > 30 GROUP BY 1, 2)
SELECT s.repo, s.file_path, s.commit_id, a.n IS NOT NULL AS is_tracked, coalesce(n, 0) AS previous_file_commits, coalesce(fixes, 0) AS previous_bug_fixes,
  coalesce(authors, 1) AS contributors FROM (SELECT * FROM sn_snapshots WHERE file_path <> 'x') s LEFT JOIN a USING (repo, file_path)""",
)
def telemetry_left_join(sn, fc):
    from faultline.operators.scoring import attach_telemetry

    telemetry = score_commits(fc).where("lines > 30").groupBy("repo", "file_path").agg(
        F.count(F.lit(1)).alias("previous_file_commits"),
        F.count_if("is_bug_fix").alias("previous_bug_fixes"),
        F.countDistinct("author").alias("contributors"),
    )
    return attach_telemetry(sn.select(*ROW), telemetry)


@query(
    "feature_set_diff", "SN",
    """WITH n AS (SELECT column_name AS feature FROM (DESCRIBE SELECT * FROM sn_snapshots))
SELECT feature, CASE WHEN feature IN ('future_bug_fix') THEN 'forbidden' WHEN feature IN ('code_loc', 'total_smells') THEN 'removed' ELSE 'kept' END AS status FROM n""",
)
def feature_set_diff(sn):
    names = sn.limit(1).select(F.explode(F.array(*[F.lit(c) for c in sn.columns])).alias("feature"))
    return op.feature_set_diff(names, ["code_loc", "total_smells"])


IMPORTANCE = ["code_loc", "code_max_cyclomatic_complexity", "code_max_nesting_depth", "total_smells", "has_large_class", "has_deep_nesting"]


@query(
    "importance_rank", "SN",
    "WITH r AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, future_bug_fix)), 8) AS importance FROM sn_snapshots" for c in IMPORTANCE)
    + ") SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM r ORDER BY rank LIMIT 5",
)
def importance_rank(sn):
    one = sn.agg(*[F.round(F.abs(F.corr(F.col(c).cast("double"), F.col("future_bug_fix").cast("double"))), 8).alias(c) for c in IMPORTANCE])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in IMPORTANCE])))
    return op.importance_rank(rows, 5)
