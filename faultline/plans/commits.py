"""Registered queries on commit text."""

from pyspark.sql import functions as F

from faultline.functions import text as t
from faultline.operators import commits as op
from faultline.plans.check_text import any_hit, any_word, lit, scored
from faultline.plans.registry import query

SCORED = f"WITH {scored('c_commits')}"


@query(
    "commit_score", "C",
    f"{SCORED} SELECT commit_id, score, k, i, s, n, is_bug_fix, noise_dominated FROM scored",
)
def commit_score(c):
    return op.score_commits(c).select("commit_id", "score", "k", "i", "s", "n", "is_bug_fix", "noise_dominated")


SWEEP = [0.2, 0.3, 0.4, 0.5, 0.6, 0.8]


@query(
    "commit_score_threshold_sweep", "C",
    f"""{SCORED}
SELECT threshold, count(*) AS commits,
       count(*) FILTER (raw >= threshold AND NOT noise_dominated) AS positives,
       count(*) FILTER (raw >= threshold AND NOT noise_dominated) / count(*) AS positive_rate
FROM (SELECT *, greatest(0e0, least(1e0, 0.20::DOUBLE * k + 0.15::DOUBLE * i + 0.25::DOUBLE * s - 0.15::DOUBLE * n)) AS raw FROM scored), (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in SWEEP)}]) AS threshold) GROUP BY threshold""",
)
def commit_score_threshold_sweep(c):
    return op.threshold_sweep(c, SWEEP)


def _rule_sql():
    resc = any_hit("m", t.RESCUE_PATTERNS)
    fix, bug = any_hit("m", [t.FIX_WORD_PATTERN]), any_hit("m", [t.BUG_WORD_PATTERN])
    rules = []
    for patterns, what in (
        (t.CHORE_PATTERNS + t.DOC_PATTERNS, "Non-bug chore/doc matching"),
        (t.FEATURE_PATTERNS, "New feature matching"),
        (t.REFACTOR_PATTERNS, "Refactoring matching"),
    ):
        for p in patterns:
            rules.append((f"NOT {resc} AND {any_hit('m', [p])}", "false", "HIGH", f"{what} '{p}'"))
    rules += [
        (f"{any_hit('m', [t.ISSUE_CLOSE_PATTERN])} OR ({fix} AND {bug})", "true", "HIGH",
         "Explicit bug fix with issue reference or defect keyword"),
        (f"{fix} AND {any_word('m', t.STYLE_WORDS)}", "false", "MEDIUM", "Typo/doc/style fix, not a code defect"),
        (fix, "true", "MEDIUM", "Code fix keyword present without noise terms"),
        (f"{bug} AND {any_word('m', t.REMEDY_WORDS)}", "true", "MEDIUM", "Defect remediation keyword present"),
    ]

    def case(k, default):
        whens = " ".join(f"WHEN {r[0]} THEN {r[k] if k == 1 else lit(r[k])}" for r in rules)
        return f"CASE {whens} ELSE {default} END"

    return f"""SELECT commit_id, {case(1, 'false')} AS label, {case(2, "'MEDIUM'")} AS confidence,
  {case(3, "'No defect indicators found in commit message'")} AS note
FROM (SELECT commit_id, trim(lower(message)) AS m FROM c_commits)"""


@query("rule_annotate", "C", _rule_sql())
def rule_annotate(c):
    return op.annotate(c).select("commit_id", "label", "confidence", "note")


STRATUM = """CASE WHEN score >= 0.70::DOUBLE THEN 'high_conf_positive' WHEN score >= 0.40::DOUBLE THEN 'boundary'
  WHEN k > 0 THEN 'near_miss' ELSE 'high_conf_negative' END"""


@query("stratum", "C", f"{SCORED} SELECT commit_id, score, {STRATUM} AS stratum FROM scored")
def stratum(c):
    return op.with_stratum(c).select("commit_id", "score", "stratum")


@query(
    "stratified_sample", "C",
    f"""{SCORED}, strat AS (SELECT *, {STRATUM} AS stratum FROM scored),
num AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('42|', repo, '|', commit_id)), commit_id) AS rn FROM strat)
SELECT commit_id, repo, message, score, stratum, is_bug_fix AS heuristic_label FROM num WHERE rn <= 125""",
)
def stratified_sample(c):
    return op.stratified_sample(c, {s: 125 for s in t.STRATA}).select(
        "commit_id", "repo", "message", "score", "stratum", F.col("is_bug_fix").alias("heuristic_label")
    )


@query(
    "first_n_commits", "C",
    """SELECT repo, commit_id, message FROM (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY commit_date, commit_id) AS rn FROM c_commits)
WHERE rn <= 120 AND length(trim(message)) > 5""",
)
def first_n_commits(c):
    return op.first_n_commits(c).select("repo", "commit_id", "message")


@query(
    "strata_distribution", "C",
    f"""{SCORED} SELECT {STRATUM} AS stratum, count(*) AS total, count(*) FILTER (is_bug_fix) AS positives,
  avg(is_bug_fix::INT) * 100 AS positive_rate_pct FROM scored GROUP BY 1""",
)
def strata_distribution(c):
    return op.strata_distribution(c)
