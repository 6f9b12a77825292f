"""Registered queries on splits and integrity checks."""

from pyspark.sql import functions as F

from faultline.operators import folds as op
from faultline.plans.registry import query

ROW = ["repo", "file_path", "commit_id"]

# A file identity with many first appearances over time, so that later folds keep test rows.
UNIT = "concat(canonical_file_id, '#', commit_id % 50)"


def units(sn):
    return sn.withColumn("unit", F.concat_ws("#", "canonical_file_id", F.col("commit_id") % 50))


def unit_folds(sn):
    return op.temporal_folds(units(sn), ["unit", "repo", "ts", "future_bug_fix", *ROW[1:]], file="unit")


FOLDS = f"""s AS (SELECT *, {UNIT} AS unit, epoch(commit_date) AS ts FROM sn_snapshots),
f AS (SELECT *, min(ts) OVER (PARTITION BY unit) AS seen, min(ts) OVER () AS lo, max(ts) OVER () AS hi FROM s),
e AS (SELECT *, lo + (hi - lo) * (i + 1) / 10e0 AS cut, lo + (hi - lo) * (i + 2) / 10e0 AS fin FROM f, range(9) r(i)),
g AS (SELECT *, CASE WHEN ts <= cut THEN 'train' WHEN ts <= fin AND NOT EXISTS (SELECT 1 FROM s x WHERE x.unit = e.unit AND x.ts <= e.cut) THEN 'test' END AS role FROM e),
u AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS fold FROM g GROUP BY i HAVING count(*) FILTER (role = 'train') > 0 AND count(*) FILTER (role = 'test') > 0),
folds AS (SELECT fold::INT AS fold, role, unit, repo, ts, future_bug_fix, file_path, commit_id FROM g JOIN u USING (i) WHERE role IS NOT NULL)"""


@query("temporal_folds", "SN", f"WITH {FOLDS} SELECT fold, role, unit, repo, file_path, commit_id FROM folds")
def temporal_folds(sn):
    return unit_folds(sn).select("fold", "role", "unit", *ROW)


@query(
    "fold_stats", "SN",
    f"""WITH {FOLDS} SELECT fold, role, count(*) AS rows, count(DISTINCT unit) AS files, sum(future_bug_fix)::BIGINT AS positives,
  strftime(to_timestamp(min(ts)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS first_date, strftime(to_timestamp(max(ts)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS last_date FROM folds GROUP BY 1, 2""",
)
def fold_stats(sn):
    """From the intervals: no row is repeated per fold."""
    day = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    return op.interval_stats(op.fold_intervals(units(sn), file="unit"), "unit").select("fold", "role", "rows", "files", "positives", day("first").alias("first_date"), day("last").alias("last_date"))


@query(
    "fold_intervals", "SN",
    f"""WITH {FOLDS}, n AS (SELECT count(DISTINCT fold) AS n FROM folds)
SELECT s.repo, s.file_path, s.commit_id, (min(fold) FILTER (role = 'train'))::INT AS train_from, (max(fold) FILTER (role = 'test'))::INT AS test_fold
FROM s LEFT JOIN folds ON s.repo = folds.repo AND s.file_path = folds.file_path AND s.commit_id = folds.commit_id GROUP BY 1, 2, 3""",
)
def fold_intervals(sn):
    return op.fold_intervals(units(sn), file="unit").select(*ROW, "train_from", "test_fold")


@query(
    "interval_checks", "SN",
    f"""WITH {FOLDS}, a AS (SELECT fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'test') AS test_rows,
  max(ts) FILTER (role = 'train') AS max_train, min(ts) FILTER (role = 'test') AS min_test FROM folds GROUP BY 1),
b AS (SELECT fold, count(*) AS shared FROM (SELECT fold, unit FROM folds WHERE role = 'train' INTERSECT SELECT fold, unit FROM folds WHERE role = 'test') GROUP BY 1)
SELECT fold, train_rows, test_rows, max_train::BIGINT AS max_train, min_test::BIGINT AS min_test, coalesce(shared, 0) AS shared_files,
  train_rows < 50 OR test_rows < 10 OR coalesce(shared, 0) > 0 OR coalesce(max_train >= min_test, false) AS violated FROM a LEFT JOIN b USING (fold)""",
)
def interval_checks(sn):
    return op.interval_checks(op.fold_intervals(units(sn), file="unit"), "unit")


@query(
    "lopo_folds", "SN",
    """SELECT r.repo AS held_out, count(*) FILTER (s.repo <> r.repo) AS train_rows, count(*) FILTER (s.repo = r.repo) AS test_rows,
  (sum(future_bug_fix) FILTER (s.repo <> r.repo))::BIGINT AS train_positives, (sum(future_bug_fix) FILTER (s.repo = r.repo))::BIGINT AS test_positives
FROM (SELECT DISTINCT repo FROM sn_snapshots) r, sn_snapshots s GROUP BY 1""",
)
def lopo_folds(sn):
    return op.lopo_folds(sn)


@query(
    "time_split", "SN",
    """WITH p AS (SELECT repo, file_path, commit_id, row_number() OVER (ORDER BY commit_date, repo, file_path, commit_id) AS pos, count(*) OVER () AS n FROM sn_snapshots)
SELECT repo, file_path, commit_id, CASE WHEN pos <= floor(0.70::DOUBLE * n) THEN 'train' WHEN pos <= floor(0.85::DOUBLE * n) THEN 'calibrate' ELSE 'test' END AS role FROM p""",
)
def time_split(sn):
    return op.time_split(sn, ROW).select(*ROW, "role")


@query("ood_split", "SN", "SELECT repo, file_path, commit_id, CASE WHEN repo IN ('repo6', 'repo7') THEN 'ood_test' ELSE 'train' END AS role FROM sn_snapshots")
def ood_split(sn):
    return op.ood_split(sn, ["repo6", "repo7"]).select(*ROW, "role")


HALF = "commit_date < TIMESTAMP '1998-01-01'"


@query(
    "identity_exclusion", "SN",
    f"""WITH s AS (SELECT *, {UNIT} AS unit FROM sn_snapshots)
SELECT repo, file_path, commit_id, unit FROM s WHERE NOT ({HALF}) AND unit NOT IN (SELECT unit FROM s WHERE {HALF})""",
)
def identity_exclusion(sn):
    u = units(sn)
    return op.exclude_known_files(u.where(f"NOT ({HALF})"), u.where(HALF), "unit").select(*ROW, "unit")


@query(
    "identity_overlap", "SN",
    f"""WITH s AS (SELECT *, {UNIT} AS unit FROM sn_snapshots),
o AS (SELECT unit FROM s WHERE {HALF} INTERSECT SELECT unit FROM s WHERE NOT ({HALF}))
SELECT count(*) AS n_overlap, (SELECT string_agg(unit, ',' ORDER BY unit) FROM (SELECT unit FROM o ORDER BY unit LIMIT 5)) AS samples FROM o""",
)
def identity_overlap(sn):
    u = units(sn)
    return op.file_overlap(u.where(HALF), u.where(f"NOT ({HALF})"), "unit")


# Folds with planted leaks, so that the checks find something.
LEAKY = f"""s AS (SELECT *, {UNIT} AS unit, epoch(commit_date)::BIGINT AS ts FROM sn_snapshots),
lf AS (SELECT concat('repo', commit_id % 5) AS fold, repo, unit, ts, future_bug_fix,
  CASE WHEN ts < 880000000 + (commit_id % 5) * 20000000 - (CASE WHEN code_loc < 25 AND commit_id % 5 > 2 THEN 30000000 ELSE 0 END) THEN 'train' ELSE 'test' END AS role
  FROM s WHERE commit_id % 5 <> 1 OR code_loc < 22)"""


def leaky(sn):
    ts = F.unix_timestamp("commit_date")
    late = F.when((F.col("code_loc") < 25) & (F.col("commit_id") % 5 > 2), 30000000).otherwise(0)
    return units(sn).where("commit_id % 5 <> 1 OR code_loc < 22").select(
        F.concat(F.lit("repo"), (F.col("commit_id") % 5).cast("string")).alias("fold"), "repo", "unit", ts.alias("ts"), "future_bug_fix",
        F.when(ts < 880000000 + (F.col("commit_id") % 5) * 20000000 - late, "train").otherwise("test").alias("role"),
    )


@query(
    "check_temporal", "SN",
    f"""WITH {LEAKY}, a AS (SELECT fold, max(ts) FILTER (role = 'train') AS max_train, min(ts) FILTER (role = 'test') AS min_test FROM lf GROUP BY 1)
SELECT *, coalesce(max_train >= min_test, false) AS violated FROM a""",
)
def check_temporal(sn):
    return op.check_temporal(leaky(sn))


@query(
    "check_identity", "SN",
    f"""WITH {LEAKY}, a AS (SELECT fold, unit FROM lf WHERE role = 'train' INTERSECT SELECT fold, unit FROM lf WHERE role = 'test')
SELECT f.fold, count(a.unit) AS shared_files, count(a.unit) > 0 AS violated FROM (SELECT DISTINCT fold FROM lf) f LEFT JOIN a ON f.fold = a.fold GROUP BY 1""",
)
def check_identity(sn):
    return op.check_identity(leaky(sn), "unit")


@query(
    "check_lopo", "SN",
    f"""WITH {LEAKY} SELECT fold, count(*) FILTER (role = 'train' AND repo = fold) AS held_out_in_train, count(*) FILTER (role = 'test' AND repo <> fold) AS foreign_in_test,
  bool_or((role = 'train' AND repo = fold) OR (role = 'test' AND repo <> fold)) AS violated FROM lf GROUP BY 1""",
)
def check_lopo(sn):
    return op.check_lopo(leaky(sn))


@query(
    "check_sizes", "SN",
    f"""WITH {LEAKY}, a AS (SELECT fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'test') AS test_rows FROM lf GROUP BY 1)
SELECT *, train_rows < 50 OR test_rows < 10 AS violated FROM a""",
)
def check_sizes(sn):
    return op.check_sizes(leaky(sn))
