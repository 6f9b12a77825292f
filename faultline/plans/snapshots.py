"""Registered queries: filters, identity, guards, set operations, statistics."""

from pyspark.sql import functions as F

from faultline.functions import files
from faultline.operators import snapshots as op
from faultline.plans.check_text import lit
from faultline.plans.registry import query

ROW = ["repo", "file_path", "commit_id"]


def _rx(column, patterns):
    return "(" + " OR ".join(f"regexp_matches({column}, {lit(p)})" for p in patterns) + ")"


@query(
    "path_exclude", "FC",
    f"""SELECT repo, file_path, commit_id, {_rx('file_path', files.PYTHON_EXCLUDED)} AS python_excluded,
  (NOT ends_with(file_path, '.java') OR {_rx('file_path', files.JAVA_EXCLUDED)}) AS java_excluded FROM fc_file_changes""",
)
def path_exclude(fc):
    path = F.col("file_path")
    return fc.select(
        *ROW,
        files.path_excluded(path).alias("python_excluded"),
        files.path_excluded(path, "java").alias("java_excluded"),
    )


@query(
    "path_pick", "FC",
    """SELECT repo, commit_id, p AS file_path FROM (SELECT repo, commit_id,
  coalesce(CASE WHEN lines % 3 > 0 THEN file_path END, replace(file_path, 'src/', 'old/')) AS p FROM fc_file_changes)
WHERE ends_with(p, '.py')""",
)
def path_pick(fc):
    moved = fc.select(
        "repo", "commit_id",
        F.when(F.col("lines") % 3 > 0, F.col("file_path")).alias("new_path"),
        F.replace("file_path", F.lit("src/"), F.lit("old/")).alias("old_path"),
    )
    return op.pick_path(moved).select("repo", "commit_id", "file_path")


@query("size_cap", "SRC", "SELECT repo, file_path, strlen(source) AS bytes FROM src_sources WHERE strlen(source) BETWEEN 1 AND 300")
def size_cap(src):
    return op.cap_size(src, 300).select("repo", "file_path", F.octet_length("source").cast("long").alias("bytes"))


@query(
    "canonical_file_id", "FC",
    "SELECT repo, file_path, commit_id, substring(md5(concat(repo, '::', replace(file_path, chr(92), '/'))), 1, 12) AS file_id FROM fc_file_changes",
)
def canonical_file_id(fc):
    return fc.select(*ROW, files.canonical_file_id(F.col("repo"), F.col("file_path")).alias("file_id"))


@query(
    "snapshot_id", "FC",
    "SELECT repo, file_path, commit_id, substring(sha256(concat(repo, '::', file_path, '::', commit_id)), 1, 24) AS snapshot_id FROM fc_file_changes",
)
def snapshot_id(fc):
    return fc.select(*ROW, files.snapshot_id(F.col("repo"), F.col("file_path"), F.col("commit_id")).alias("snapshot_id"))


_LANG = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{l}'" for e, l in files.EXTENSIONS.items()) + " ELSE 'plaintext' END"
_EXT = "lower(regexp_extract(file_path, '[^/.][^/]*(\\.[^./]+)$', 1))"


@query("language_tag", "FC", f"SELECT repo, file_path, commit_id, {_LANG} AS language FROM (SELECT *, {_EXT} AS ext FROM fc_file_changes)")
def language_tag(fc):
    return fc.select(*ROW, files.language_of(F.col("file_path")).alias("language"))


_KIND = f"""CASE WHEN ext = '.py' THEN 'python' WHEN ext IN ({', '.join(lit(e) for e in files.EXTENSIONS)}) THEN 'polyglot'
  WHEN ext IN ({', '.join(lit(e) for e in files.BINARY_EXTENSIONS)}) THEN 'binary' ELSE 'plaintext' END"""


@query(
    "file_class", "SRC",
    f"""SELECT repo, file_path, kind AS file_class,
  CASE kind WHEN 'python' THEN 'python' WHEN 'polyglot' THEN {_LANG} ELSE kind END AS language,
  CASE WHEN kind = 'binary' THEN 0 ELSE len(string_split(regexp_replace(source, '\\n$', ''), chr(10))) END::INT AS loc,
  kind = 'python' AS is_ml_prediction,
  CASE kind WHEN 'python' THEN 'normal' WHEN 'binary' THEN 'non_code_file' ELSE 'unsupported_language' END AS guardrail_status
FROM (SELECT *, {_KIND} AS kind FROM (SELECT *, {_EXT} AS ext FROM src_sources))""",
)
def file_class(src):
    return op.classify_files(src).drop("source")


@query(
    "ffi_guardrail", "SRC",
    f"""WITH s AS (SELECT repo, CASE WHEN ends_with(file_path, '.go') AND repo = 'repo1' THEN replace(file_path, '.go', '.rs')
    WHEN ends_with(file_path, '.java') AND repo = 'repo4' THEN replace(file_path, '.java', '.cpp') ELSE file_path END AS file_path,
    concat(CASE WHEN length(source) % 5 = 0 THEN concat('import ctypes', chr(10)) ELSE '' END, source) AS source FROM src_sources),
r AS (SELECT repo, bool_or(ends_with(file_path, '.rs')) AS rust, bool_or(ends_with(file_path, '.c') OR ends_with(file_path, '.cpp') OR ends_with(file_path, '.pyx')) AS nat FROM s GROUP BY repo),
t AS (SELECT s.repo, file_path, CASE WHEN rust THEN 'rust' WHEN nat THEN 'native' WHEN {_rx('source', files.NATIVE_IMPORTS)} THEN 'bindings' ELSE 'none' END AS reason FROM s JOIN r USING (repo))
SELECT *, CASE WHEN reason = 'none' THEN 'normal' ELSE 'advisory' END AS guardrail FROM t""",
)
def ffi_guardrail(src):
    path = F.col("file_path")
    mixed = src.select(
        "repo",
        F.when(path.endswith(".go") & (F.col("repo") == "repo1"), F.replace(path, F.lit(".go"), F.lit(".rs")))
        .when(path.endswith(".java") & (F.col("repo") == "repo4"), F.replace(path, F.lit(".java"), F.lit(".cpp")))
        .otherwise(path).alias("file_path"),
        F.concat(F.when(F.length("source") % 5 == 0, "import ctypes\n").otherwise(""), "source").alias("source"),
    )
    return op.native_guardrail(mixed).drop("source")


@query(
    "engine_route", "SN FC",
    """SELECT s.repo, s.file_path, s.commit_id, t.file_path IS NOT NULL AS is_tracked, CASE WHEN t.file_path IS NOT NULL THEN 'full' ELSE 'static' END AS engine
FROM sn_snapshots s LEFT JOIN (SELECT DISTINCT repo, file_path FROM fc_file_changes WHERE lines > 240) t USING (repo, file_path)""",
)
def engine_route(sn, fc):
    return op.route_engine(sn, fc.where("lines > 240")).select(*ROW, "is_tracked", "engine")


GUARDED = """g AS (SELECT repo, file_path, commit_id, future_bug_fix,
  (count(*) OVER (PARTITION BY repo) < 7250)::INT AS exclude_from_training,
  (avg(future_bug_fix) OVER (PARTITION BY repo) < 0.05 OR avg(future_bug_fix) OVER (PARTITION BY repo) > 0.348)::INT AS label_outlier
  FROM sn_snapshots)"""


def guarded(sn):
    return op.repo_guards(sn.select(*ROW, "future_bug_fix"), min_rows=7250, high=0.348)


@query("repo_guards", "SN", f"WITH {GUARDED} SELECT * FROM g")
def repo_guards(sn):
    return guarded(sn)


@query(
    "guard_filter", "SN",
    f"""WITH {GUARDED} SELECT count(*) AS total, count(*) FILTER (exclude_from_training = 1) AS excluded_small,
  count(*) FILTER (exclude_from_training <> 1 AND label_outlier = 1) AS excluded_outlier,
  count(*) FILTER (exclude_from_training <> 1 AND label_outlier <> 1) AS kept FROM g""",
)
def guard_filter(sn):
    return op.guard_counts(guarded(sn))


@query("guard_filter_rows", "SN", f"WITH {GUARDED} SELECT repo, file_path, commit_id FROM g WHERE exclude_from_training <> 1 AND label_outlier <> 1")
def guard_filter_rows(sn):
    return op.guard_filter(guarded(sn)).select(*ROW)


@query(
    "label_domain", "SN",
    """SELECT repo, file_path, commit_id, future_bug_fix::INT AS future_bug_fix FROM
  (SELECT repo, file_path, commit_id, CASE WHEN code_loc % 10 = 0 THEN 2.0::DOUBLE WHEN code_loc % 10 = 1 THEN NULL ELSE future_bug_fix::DOUBLE END AS future_bug_fix FROM sn_snapshots)
WHERE future_bug_fix IN (0, 1)""",
)
def label_domain(sn):
    odd = F.when(F.col("code_loc") % 10 == 0, 2.0).when(F.col("code_loc") % 10 == 1, None).otherwise(F.col("future_bug_fix").cast("double"))
    return op.valid_labels(sn.select(*ROW, odd.alias("future_bug_fix")))


@query(
    "zero_fill", "SN",
    """SELECT repo, file_path, commit_id, coalesce(CASE WHEN code_loc % 7 > 0 THEN code_loc END, 0) AS code_loc, 0 AS code_sloc FROM sn_snapshots""",
)
def zero_fill(sn):
    holes = sn.select(*ROW, F.when(F.col("code_loc") % 7 > 0, F.col("code_loc")).alias("code_loc"))
    return op.zero_fill(holes, ["code_loc", "code_sloc"])


@query(
    "flatten_features", "SN",
    """SELECT repo, file_path, commit_id, canonical_file_id, future_bug_fix, code_loc, code_max_cyclomatic_complexity, code_max_nesting_depth,
  has_large_class, has_high_complexity, has_deep_nesting, total_smells FROM sn_snapshots""",
)
def flatten_features(sn):
    return op.flatten_features(op.nest_features(sn.drop("commit_date")))


@query(
    "snapshot_upsert", "SN",
    """WITH o AS (SELECT repo, file_path, commit_id, code_loc, 0 AS batch FROM sn_snapshots WHERE code_loc % 3 < 2),
n AS (SELECT repo, file_path, commit_id, code_loc + 1000 AS code_loc, 1 AS batch FROM sn_snapshots WHERE code_loc % 3 > 0)
SELECT repo, file_path, commit_id, max_by(code_loc, batch) AS code_loc FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1, 2, 3""",
)
def snapshot_upsert(sn):
    rows = sn.select(*ROW, "code_loc")
    old = rows.where("code_loc % 3 < 2")
    new = rows.where("code_loc % 3 > 0").withColumn("code_loc", F.col("code_loc") + 1000)
    return op.upsert(old, new, ROW)


@query(
    "incremental_skip", "C FC",
    "SELECT commit_id, repo FROM c_commits WHERE commit_id NOT IN (SELECT commit_id FROM fc_file_changes WHERE lines > 100)",
)
def incremental_skip(c, fc):
    return op.skip_done(c.select("commit_id", "repo"), fc.where("lines > 100"), "commit_id")


@query(
    "dedup_snapshots", "FC",
    """SELECT repo, file_path, day, commit_id, lines FROM (SELECT repo, file_path, strftime(date_trunc('month', commit_date), '%Y-%m') AS day, commit_id, lines,
  row_number() OVER (PARTITION BY repo, file_path, date_trunc('month', commit_date) ORDER BY commit_id) AS rn FROM fc_file_changes) WHERE rn = 1""",
)
def dedup_snapshots(fc):
    monthly = fc.select("repo", "file_path", F.date_format("commit_date", "yyyy-MM").alias("day"), "commit_id", "lines")
    return op.dedup(monthly, ["repo", "file_path", "day"], ["commit_id"])


@query(
    "union_repos", "SN",
    """SELECT repo, file_path, commit_id, code_loc, NULL::INT AS total_smells FROM sn_snapshots WHERE repo < 'repo4'
UNION ALL SELECT repo, file_path, commit_id, NULL, total_smells FROM sn_snapshots WHERE repo >= 'repo4'""",
)
def union_repos(sn):
    return op.union_repos([
        sn.where("repo < 'repo4'").select(*ROW, "code_loc"),
        sn.where("repo >= 'repo4'").select(*ROW, "total_smells"),
    ])


@query(
    "merged_matches_sum", "SN",
    """SELECT sum(n)::BIGINT AS sum_of_parts, (SELECT count(*) FROM sn_snapshots) AS merged_rows,
  sum(n) = (SELECT count(*) FROM sn_snapshots) AS matches FROM (SELECT repo, count(*) AS n FROM sn_snapshots GROUP BY repo)""",
)
def merged_matches_sum(sn):
    parts = sn.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("sum_of_parts"))
    merged = sn.agg(F.count(F.lit(1)).alias("merged_rows"))
    return parts.withColumn("merged_rows", merged.scalar()).withColumn("matches", F.col("sum_of_parts") == F.col("merged_rows"))


@query(
    "even_sample", "C",
    """WITH p AS (SELECT repo, commit_id, row_number() OVER (PARTITION BY repo ORDER BY commit_date, commit_id) - 1 AS position, count(*) OVER (PARTITION BY repo) AS n FROM c_commits),
g AS (SELECT DISTINCT repo, round_even(i * (n - 1) / 499e0, 0)::BIGINT AS position FROM (SELECT DISTINCT repo, n FROM p), range(500) r(i))
SELECT p.repo, commit_id, position FROM p JOIN g USING (repo, position) WHERE n > 500 UNION ALL SELECT repo, commit_id, position FROM p WHERE n <= 500""",
)
def even_sample(c):
    return op.even_sample(c).select("repo", "commit_id", "position")


@query(
    "even_sample_floor", "C",
    """WITH p AS (SELECT repo, commit_id, row_number() OVER (PARTITION BY repo ORDER BY commit_date, commit_id) - 1 AS position, count(*) OVER (PARTITION BY repo) AS n FROM c_commits),
g AS (SELECT DISTINCT repo, floor(i * (n - 1) / 499e0)::BIGINT AS position FROM (SELECT DISTINCT repo, n FROM p), range(500) r(i))
SELECT p.repo, commit_id, position FROM p JOIN g USING (repo, position) WHERE n > 500 UNION ALL SELECT repo, commit_id, position FROM p WHERE n <= 500""",
)
def even_sample_floor(c):
    return op.even_sample(c, floor_index=True).select("repo", "commit_id", "position")


@query(
    "last_n_per_key", "C",
    """SELECT repo, commit_id, message FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY commit_date DESC, commit_id DESC) AS rn FROM c_commits) WHERE rn <= 100""",
)
def last_n_per_key(c):
    return op.newest_per_key(c, "repo", ["commit_date", "commit_id"], 100).select("repo", "commit_id", "message")


@query(
    "seeded_sample", "SN",
    """SELECT * FROM (SELECT concat(repo, '|', file_path, '|', commit_id) AS id, code_loc, future_bug_fix FROM sn_snapshots) ORDER BY md5(concat('42|', id)), id LIMIT 1000""",
)
def seeded_sample(sn):
    return op.seeded_sample(sn.select(F.concat_ws("|", *ROW).alias("id"), "code_loc", "future_bug_fix"), "id")


@query(
    "dataset_stats", "SN",
    """SELECT count(*) AS total_rows, count(DISTINCT repo) AS repos, count(DISTINCT canonical_file_id) AS unique_files, sum(future_bug_fix)::BIGINT AS positive_labels,
  round(sum(future_bug_fix) * 100e0 / count(*), 2) AS positive_rate_pct, strftime(min(commit_date), '%Y-%m-%d') AS earliest_snapshot,
  strftime(max(commit_date), '%Y-%m-%d') AS latest_snapshot FROM sn_snapshots""",
)
def dataset_stats(sn):
    return op.dataset_stats(sn)


@query(
    "repo_summary", "SN",
    """SELECT repo, count(*) AS snapshots, sum(future_bug_fix)::BIGINT AS bug_fix_snapshots, round(avg(future_bug_fix) * 100, 1) AS bug_fix_pct,
  round(avg(code_loc), 1) AS mean_loc, round(avg(total_smells), 1) AS mean_smells FROM sn_snapshots GROUP BY repo""",
)
def repo_summary(sn):
    return op.repo_summary(sn)


TIERS = "CASE WHEN repo IN ('repo0', 'repo1', 'repo2') THEN 'tier2' WHEN repo IN ('repo3', 'repo4') THEN 'tier3' END"


def tiers_of(c):
    return c.select("repo").distinct().select("repo", F.expr(TIERS).alias("tier")).where("tier IS NOT NULL")


@query("tier_lookup", "SN C", f"SELECT repo, file_path, commit_id, coalesce({TIERS}, 'tier1') AS tier FROM sn_snapshots")
def tier_lookup(sn, c):
    return op.tier_of(sn.select(*ROW), tiers_of(c)).select(*ROW, "tier")


@query(
    "mining_progress", "SN C",
    f"""WITH r AS (SELECT coalesce({TIERS}, 'tier1') AS tier, repo, count(*) AS rows, sum(future_bug_fix)::BIGINT AS positives, sum((code_loc % 20 = 0)::INT)::BIGINT AS fallbacks FROM sn_snapshots GROUP BY 1, 2),
t AS (SELECT tier, count(*) AS target FROM (SELECT DISTINCT repo, {TIERS} AS tier FROM c_commits) WHERE tier IS NOT NULL GROUP BY ROLLUP(tier)),
x AS (SELECT tier, repo, sum(rows)::BIGINT AS rows, sum(positives)::BIGINT AS positives, sum(fallbacks)::BIGINT AS fallbacks, count(*) AS done FROM r GROUP BY ROLLUP(tier, repo))
SELECT coalesce(x.tier, 'all') AS tier, coalesce(repo, 'all') AS repo, rows, positives, positives * 100 / rows AS positive_pct, fallbacks * 100 / rows AS fallback_pct,
  done, coalesce(target, 0) AS target FROM x LEFT JOIN t ON x.tier IS NOT DISTINCT FROM t.tier""",
)
def mining_progress(sn, c):
    return op.mining_progress(sn.withColumn("parse_fallback", (F.col("code_loc") % 20 == 0).cast("int")), tiers_of(c))


CHECKED = ["code_loc", "code_max_cyclomatic_complexity", "code_max_nesting_depth", "total_smells", "constant"]


@query(
    "distribution_check", "SN",
    """WITH u AS (UNPIVOT (SELECT commit_date, code_loc::DOUBLE AS code_loc, code_max_cyclomatic_complexity::DOUBLE AS code_max_cyclomatic_complexity,
  code_max_nesting_depth::DOUBLE AS code_max_nesting_depth, total_smells::DOUBLE AS total_smells, 1e0 AS constant FROM sn_snapshots)
  ON code_loc, code_max_cyclomatic_complexity, code_max_nesting_depth, total_smells, constant INTO NAME "column" VALUE v)
SELECT "column", min(v) AS min, max(v) AS max, avg(v) AS mean, stddev_samp(v) AS std, min(v) = max(v) AS zero_variance,
  date_diff('day', min(commit_date), max(commit_date)) AS span_days FROM u GROUP BY 1""",
)
def distribution_check(sn):
    return op.distribution_check(sn.withColumn("constant", F.lit(1)), CHECKED)


@query(
    "zero_variance", "SN",
    """SELECT 'constant' AS "column" FROM sn_snapshots HAVING min(1) = max(1) UNION ALL SELECT 'code_loc' FROM sn_snapshots HAVING min(code_loc) = max(code_loc)
UNION ALL SELECT 'total_smells' FROM sn_snapshots HAVING min(total_smells) = max(total_smells)
UNION ALL SELECT 'code_max_nesting_depth' FROM sn_snapshots HAVING min(code_max_nesting_depth) = max(code_max_nesting_depth)""",
)
def zero_variance(sn):
    return op.zero_variance(sn.withColumn("constant", F.lit(1)), CHECKED)


_GRID = [(s, c, t) for s, c, ts in op.SENSITIVITY_GRID if c != "code_sloc" for t in ts]


@query(
    "sensitivity", "SN",
    "\nUNION ALL ".join(
        f"""SELECT '{s}' AS smell, {t} AS threshold, count(*) FILTER ({c} >= {t}) AS active_snapshots,
  round(coalesce(avg(future_bug_fix) FILTER ({c} >= {t}), 0) * 100, 8) AS active_bug_rate,
  round(coalesce(CASE WHEN min(({c} >= {t})::INT) < max(({c} >= {t})::INT) THEN corr(({c} >= {t})::INT, future_bug_fix) END, 0), 8) AS defect_correlation FROM sn_snapshots"""
        for s, c, t in _GRID
    ),
)
def sensitivity(sn):
    return op.sensitivity(sn).withColumn("active_bug_rate", F.round("active_bug_rate", 8)).withColumn(
        "defect_correlation", F.round("defect_correlation", 8)
    )


@query(
    "rank_files", "PR",
    "SELECT repo, file_path, commit_id, p_full FROM pr_predictions ORDER BY p_full DESC",
)
def rank_files(pr):
    return pr.select(*ROW, "p_full").orderBy(F.desc("p_full"), *ROW)
