"""Registered queries on source texts and reports."""

from pyspark.sql import functions as F

from faultline.functions import languages as lang
from faultline.operators import reporting, scoring
from faultline.operators import source_metrics as op
from faultline.plans.check_text import lit
from faultline.plans.evaluation import rounded
from faultline.plans.registry import query

ROW = ["repo", "file_path", "commit_id"]
LINES = """ln AS (SELECT repo, file_path, source, regexp_extract(file_path, '\\.[a-z]+$') AS ext, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS line
  FROM (SELECT *, string_split(regexp_replace(source, '\\n$', ''), chr(10)) AS ls FROM src_sources))"""
# Comment state as of each line from the last marker before it; only non-blank lines carry markers.
STATE = f"""{LINES},
mk AS (SELECT *, trim(line) = '' AS blank, CASE WHEN contains(line, '*/') THEN 0 WHEN contains(line, '/*') THEN 1 END AS mark,
  regexp_matches(line, CASE WHEN ext IN ('.java', '.go') THEN '^\\s*//' ELSE '^\\s*(?://|#)' END) AS single FROM ln),
st AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY repo, file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside FROM mk),
cl AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN inside OR contains(line, '/*') THEN 'block' WHEN single THEN 'single' ELSE 'code' END AS kind FROM st)"""


@query("line_table", "SRC", f"WITH {LINES} SELECT repo, file_path, line_no, line FROM ln")
def line_table(src):
    return op.line_table(src)


@query(
    "line_counts", "SRC",
    f"""WITH {LINES}, c AS (SELECT repo, file_path, count(*)::INT AS loc, count(*) FILTER (trim(line) = '')::INT AS blank_lines, count(*) FILTER (starts_with(trim(line), '#'))::INT AS comment_lines FROM ln GROUP BY 1, 2)
SELECT *, loc - comment_lines - blank_lines AS sloc, comment_lines / loc AS comment_density FROM c""",
)
def line_counts(src):
    return op.line_counts(src)


@query(
    "block_comment_lines", "SRC",
    f"""WITH {STATE}, c AS (SELECT repo, file_path, count(*)::INT AS loc, count(*) FILTER (kind = 'blank')::INT AS blank_lines, count(*) FILTER (kind IN ('block', 'single'))::INT AS comment_lines FROM cl GROUP BY 1, 2)
SELECT *, loc - comment_lines - blank_lines AS sloc, round(comment_lines / loc, 3) AS comment_density FROM c""",
)
def block_comment_lines(src):
    return op.comment_profile(src).select("repo", "file_path", "loc", "blank_lines", "comment_lines", "sloc", "comment_density")


@query(
    "java_comment_lines", "SRC",
    f"""WITH {LINES}, j AS (SELECT *, CASE WHEN contains(line, '*/') THEN 0 WHEN contains(line, '/*') THEN 1 END AS mark FROM ln WHERE ext = '.java'),
s AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY repo, file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside FROM j)
SELECT repo, file_path, count(*) FILTER (inside OR starts_with(trim(line), '//') OR contains(line, '/*'))::INT AS comment_lines FROM s GROUP BY 1, 2""",
)
def java_comment_lines(src):
    return src.where("file_path LIKE '%.java'").select("repo", "file_path", op.java_comment_lines(op.lines_of(F.col("source"))).alias("comment_lines"))


@query(
    "todo_count", "SRC",
    f"WITH {STATE} SELECT repo, file_path, count(*) FILTER (kind IN ('single', 'code') AND regexp_matches(line, 'TODO|FIXME|HACK'))::INT AS todo_count FROM cl GROUP BY 1, 2",
)
def todo_count(src):
    return op.comment_profile(src).select("repo", "file_path", "todo_count")


BALANCE = """b AS (SELECT *, sum((length(line) - length(replace(line, '{', ''))) - (length(line) - length(replace(line, '}', '')))) OVER w AS s FROM ln WINDOW w AS (PARTITION BY repo, file_path ORDER BY line_no)),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY repo, file_path ORDER BY line_no)) AS depth FROM b)"""


@query(
    "brace_nesting", "SRC",
    f"WITH {LINES}, {BALANCE} SELECT repo, file_path, max(depth)::INT AS brace_depth, greatest(0, max(depth) - 1)::INT AS java_depth FROM d GROUP BY 1, 2",
)
def brace_nesting(src):
    return src.select(
        "repo", "file_path", op.brace_depth(op.lines_of(F.col("source"))).alias("brace_depth"), op.java_nesting(F.col("source")).alias("java_depth")
    )


@query(
    "indent_nesting", "SRC",
    f"""WITH {LINES} SELECT repo, file_path, coalesce(max((length(line) - length(ltrim(line))) // 4) FILTER (trim(line) <> '' AND NOT contains(line, '{{') AND NOT contains(line, '}}')), 0)::INT AS indent_depth FROM ln GROUP BY 1, 2""",
)
def indent_nesting(src):
    return src.select("repo", "file_path", op.indent_depth(op.lines_of(F.col("source"))).alias("indent_depth"))


def _branch_sql():
    def hits(patterns):
        return " + ".join(f"len(regexp_extract_all(line, {lit(p)}))" for p in patterns)

    return f"""SELECT repo, file_path, (1 + coalesce(sum(CASE ext WHEN '.java' THEN {hits(lang.LANGUAGES['java']['branches'])}
  WHEN '.go' THEN {hits(lang.LANGUAGES['go']['branches'])} ELSE {hits(lang.OTHER['branches'])} END) FILTER (kind = 'code'), 0))::INT AS cyclomatic_complexity FROM cl GROUP BY 1, 2"""


@query("branch_complexity", "SRC", f"WITH {STATE} {_branch_sql()}")
def branch_complexity(src):
    return op.comment_profile(src).select("repo", "file_path", "cyclomatic_complexity")


# The given sources declare few functions, so declarations are put in front of the whole text.
DECLS = {
    ".java": "public static int run(int a, int b) {\nreturn a;\n}\nvoid stop() {\n}\n",
    ".go": "func (s *T) Add(a int, b int, c string) int {\nreturn a\n}\nfunc Nop() {\n}\n",
    ".py": "def g(x):\n    return x\n\n",
}


def declared(src):
    front = F.lit("")
    for ext, text in DECLS.items():
        front = F.when(F.col("file_path").endswith(ext), F.lit(text)).otherwise(front)
    return src.withColumn("source", F.concat(front, "source"))


def _declared_sql():
    whens = " ".join(f"WHEN ends_with(file_path, '{e}') THEN {lit(t).replace(chr(10), chr(39) + '||chr(10)||' + chr(39))}" for e, t in DECLS.items())
    return f"decl AS (SELECT repo, file_path, regexp_extract(file_path, '\\.[a-z]+$') AS ext, concat(CASE {whens} ELSE '' END, source) AS source FROM src_sources)"


@query(
    "function_params", "SRC",
    f"""WITH {_declared_sql()},
f AS (SELECT repo, file_path, CASE ext WHEN '.java' THEN regexp_extract_all(source, {lit(lang.LANGUAGES['java']['function'])}, 2)
  WHEN '.go' THEN regexp_extract_all(source, {lit(lang.LANGUAGES['go']['function'])}, 2) WHEN '.py' THEN regexp_extract_all(source, 'def\\s+\\w+\\s*\\(([^)]*)\\)', 1) ELSE [] END AS ps, source FROM decl),
g AS (SELECT repo, file_path, len(ps) AS n, list_transform(ps, lambda p: CASE WHEN trim(p) = '' THEN 0 ELSE len(string_split(p, ',')) END) AS cs FROM f)
SELECT repo, file_path, n::INT AS function_count, coalesce(list_max(cs), 0)::INT AS max_param_count, CASE WHEN n > 0 THEN round(list_sum(cs) / n, 1) ELSE 0 END AS avg_param_count FROM g""",
)
def function_params(src):
    profile = op.function_profile(op.comment_profile(declared(src)))
    return profile.select("repo", "file_path", "function_count", "max_param_count", "avg_param_count")


@query(
    "function_sizes", "SRC",
    f"""WITH {LINES}, n AS (SELECT repo, file_path, ext, any_value(source) AS source, count(*) FILTER (trim(line) <> '') AS code FROM ln GROUP BY 1, 2, 3),
k AS (SELECT repo, file_path, round((count(*) FILTER (trim(line) <> '' AND NOT starts_with(line, '#'))) / 1e0, 1) AS size FROM ln WHERE ext = '.py' GROUP BY 1, 2)
SELECT repo, file_path, size AS avg_function_size, floor(size * 1.6::DOUBLE)::INT AS max_function_size FROM k""",
)
def function_sizes(src):
    profile = op.function_profile(op.comment_profile(src.where("file_path LIKE '%.py'")))
    return profile.select("repo", "file_path", "avg_function_size", "max_function_size")


@query(
    "function_spans", "SRC",
    f"""WITH {_declared_sql()},
ln AS (SELECT repo, file_path, ext, unnest(range(1, len(ls) + 1)) AS no, unnest(ls) AS line FROM (SELECT *, string_split(regexp_replace(source, '\\n$', ''), chr(10)) AS ls FROM decl)),
p AS (SELECT *, length(line) - length(ltrim(line)) AS ind FROM ln WHERE ext = '.py' AND trim(line) <> ''),
e AS (SELECT d.repo, d.file_path, d.no, coalesce(min(x.no), 1000000000) AS stop FROM p d LEFT JOIN p x ON d.repo = x.repo AND d.file_path = x.file_path AND x.no > d.no AND x.ind <= d.ind
  WHERE regexp_matches(d.line, '^\\s*def\\s') GROUP BY 1, 2, 3),
py AS (SELECT e.repo, e.file_path, e.no, max(p.no) - e.no + 1 AS size FROM e JOIN p ON e.repo = p.repo AND e.file_path = p.file_path AND p.no >= e.no AND p.no < e.stop GROUP BY 1, 2, 3),
br AS (SELECT repo, file_path, unnest([1, 2]) AS no, unnest([3, 2]) AS size FROM decl WHERE ext = '.java')
SELECT repo, file_path, (row_number() OVER (PARTITION BY repo, file_path ORDER BY no) - 1)::INT AS ordinal, size::INT AS size FROM (SELECT * FROM py UNION ALL SELECT * FROM br)""",
)
def function_spans(src):
    return op.function_spans(declared(src))


@query(
    "class_import_counts", "SRC",
    f"""SELECT repo, file_path, CASE ext WHEN '.java' THEN len(regexp_extract_all(source, {lit(lang.LANGUAGES['java']['klass'])})) WHEN '.py' THEN len(regexp_extract_all(source, '(?m)^\\s*class\\s+\\w+'))
  WHEN '.go' THEN len(regexp_extract_all(source, {lit(lang.LANGUAGES['go']['klass'])})) ELSE 0 END::INT AS class_count,
  len(regexp_extract_all(source, CASE WHEN ext = '.py' THEN '(?m)^\\s*(?:import|from)\\s+\\w' ELSE '(?m)^\\s*import\\s+' END))::INT AS import_count
FROM (SELECT *, regexp_extract(file_path, '\\.[a-z]+$') AS ext FROM src_sources)""",
)
def class_import_counts(src):
    return op.declarations(src)


CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(source, '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', '', 'g'), '"(?:[^"\\]|\\.)*"', '""', 'g')"""
CLEAN_PYTHON = r"""regexp_replace(regexp_replace(source, '#[^\n]*', '', 'g'), '"(?:[^"\\]|\\.)*"', '""', 'g')"""
HALSTEAD = f"""cleaned AS (SELECT repo, file_path, source, CASE WHEN ends_with(file_path, '.py') THEN {CLEAN_PYTHON} ELSE {CLEAN} END AS clean FROM src_sources),
tok AS (SELECT repo, file_path, source, regexp_extract_all(clean, {lit(lang.OPERATORS)}) AS ops, list_filter(regexp_extract_all(clean, {lit(lang.IDENTIFIERS)}),
  lambda w: NOT CASE WHEN ends_with(file_path, '.py') THEN list_contains([{', '.join(lit(k) for k in lang.PYTHON_KEYWORDS)}], w)
    ELSE list_contains([{', '.join(lit(k) for k in lang.JAVA_KEYWORDS)}], w) END) AS ids FROM cleaned),
sz AS (SELECT repo, file_path, source, len(ops) AS na, len(ids) AS nb, len(list_distinct(ops)) AS a, len(list_distinct(ids)) AS b FROM tok),
hv AS (SELECT repo, file_path, source, CASE WHEN b > 0 AND a + b > 1 THEN (na + nb) * log2(a + b) ELSE 0 END AS v, CASE WHEN b > 0 THEN a / 2e0 * (nb / b) ELSE 0 END AS d FROM sz)"""


@query(
    "halstead", "SRC",
    f"""WITH {HALSTEAD} SELECT repo, file_path, round(v, 3) AS halstead_volume, round(d, 3) AS halstead_difficulty, round(v * d, 3) AS halstead_effort, round(v / 3000, 6) AS halstead_bugs FROM hv""",
)
def halstead(src):
    return op.with_halstead(src).drop("source")


@query(
    "maintainability_index", "SRC",
    f"""WITH {HALSTEAD}, {STATE}, l AS (SELECT repo, file_path, count(*) AS loc FROM ln GROUP BY 1, 2), cc AS ({_branch_sql()})
SELECT repo, file_path, round(greatest(0, (171 - 5.2::DOUBLE * ln(greatest(round(v, 3), 1)) - 0.23::DOUBLE * greatest(cyclomatic_complexity, 1) - 16.2::DOUBLE * ln(greatest(loc, 1))) * (100e0 / 171e0)), 2) AS maintainability_index
FROM hv JOIN l USING (repo, file_path) JOIN cc USING (repo, file_path)""",
)
def maintainability_index(src):
    metrics = op.with_halstead(op.comment_profile(src))
    return metrics.select("repo", "file_path", op.maintainability_index(F.col("halstead_volume"), F.col("cyclomatic_complexity"), F.col("loc")).alias("maintainability_index"))


@query(
    "cognitive_complexity", "SRC",
    f"""WITH cleaned AS (SELECT repo, file_path, {CLEAN} AS clean FROM src_sources),
ln AS (SELECT repo, file_path, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT *, string_split(regexp_replace(clean, '\\n$', ''), chr(10)) AS ls FROM cleaned)),
h AS (SELECT *, len(regexp_extract_all(line, {lit(lang.JAVA_NESTING)})) AS hits, len(regexp_extract_all(line, {lit(lang.JAVA_JUMPS)})) AS jumps,
  len(regexp_extract_all(line, '\\{{')) - len(regexp_extract_all(line, '\\}}')) AS net FROM ln),
b AS (SELECT *, sum(hits + net) OVER (PARTITION BY repo, file_path ORDER BY line_no) AS s FROM h),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY repo, file_path ORDER BY line_no)) AS after FROM b),
q AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY repo, file_path ORDER BY line_no), 0) AS depth FROM d)
SELECT repo, file_path, sum(CASE WHEN hits > 0 THEN hits + depth ELSE 0 END + jumps)::INT AS cognitive_complexity FROM q GROUP BY 1, 2""",
)
def cognitive_complexity(src):
    return src.select("repo", "file_path", op.cognitive_complexity(F.col("source")).alias("cognitive_complexity"))


@query("code_metrics", "SRC")
def code_metrics(src):
    """All metric columns at once; its parts have check SQL under their own keys."""
    return op.code_metrics(src).drop("source", "function_sizes", "class_sizes", "param_counts", "function_complexities")


# Metric columns from snapshot arithmetic, so that every rule set meets all its smells.
METRICS = """m AS (SELECT repo, file_path, commit_id, code_loc AS loc, code_loc - code_loc % 17 AS sloc, code_max_nesting_depth AS max_nesting_depth,
  code_max_cyclomatic_complexity AS max_cyclomatic_complexity, code_max_cyclomatic_complexity AS cyclomatic_complexity, 1 + code_loc % 4 AS class_count,
  code_loc % 90 AS f1, code_loc % 61 AS f2, code_loc % 7 AS p1, code_loc % 5 AS p2, code_loc AS c1, code_loc % 9 AS todo_count, (code_loc % 101)::DOUBLE AS maintainability_index FROM sn_snapshots)"""


def metric_rows(sn):
    loc, cc = F.col("code_loc"), F.col("code_max_cyclomatic_complexity")
    return sn.select(
        *ROW, loc.alias("loc"), (loc - loc % 17).alias("sloc"), F.col("code_max_nesting_depth").alias("max_nesting_depth"),
        cc.alias("max_cyclomatic_complexity"), cc.alias("cyclomatic_complexity"), (1 + loc % 4).alias("class_count"),
        F.array(loc % 90, loc % 61).alias("function_sizes"), F.array(loc % 7, loc % 5).alias("param_counts"), F.array(loc).alias("class_sizes"),
        (loc % 9).alias("todo_count"), (loc % 101).cast("double").alias("maintainability_index"),
        ((loc % 90 + loc % 61) / 2.0).alias("avg_function_size"), F.greatest(loc % 90, loc % 61).alias("max_function_size"),
        F.greatest(loc % 7, loc % 5).alias("max_param_count"), loc.alias("max_class_size"),
    )


FLAGGED = f"""{METRICS},
c AS (SELECT *, 'python' AS ruleset, (f1 >= 50)::INT + (f2 >= 50)::INT AS long_method_count, (p1 >= 5)::INT + (p2 >= 5)::INT AS long_param_count, (c1 >= 300)::INT AS large_class_count,
  (max_nesting_depth >= 4)::INT AS deep_nesting_count, (max_cyclomatic_complexity >= 10)::INT AS high_complexity_count FROM m
UNION ALL SELECT *, 'java', (f1 > 50)::INT + (f2 > 50)::INT, (p1 > 5)::INT + (p2 > 5)::INT, (loc / class_count > 300)::INT, (max_nesting_depth > 4)::INT, (max_cyclomatic_complexity > 10)::INT FROM m
UNION ALL SELECT *, 'polyglot', ((f1 + f2) / 2 > 35 OR greatest(f1, f2) > 45)::INT, (greatest(p1, p2) >= 5)::INT, ((class_count <= 2 AND sloc > 250) OR sloc > 400)::INT, (max_nesting_depth >= 4)::INT, (cyclomatic_complexity >= 15)::INT FROM m),
fl AS (SELECT *, (long_method_count > 0)::INT AS has_long_method, (long_param_count > 0)::INT AS has_long_param_list, (large_class_count > 0)::INT AS has_large_class, (deep_nesting_count > 0)::INT AS has_deep_nesting,
  (high_complexity_count > 0)::INT AS has_high_complexity FROM c),
flags AS (SELECT *, CASE WHEN ruleset = 'python' THEN long_method_count + long_param_count + large_class_count + deep_nesting_count + high_complexity_count
  ELSE has_long_method + has_long_param_list + has_large_class + has_deep_nesting + has_high_complexity END AS total_smells FROM fl)"""
RULESETS = ["python", "java", "polyglot"]


def flagged(sn, ruleset):
    return op.smell_flags(metric_rows(sn), ruleset).withColumn("ruleset", F.lit(ruleset))


def over_rulesets(fn):
    out = None
    for r in RULESETS:
        out = fn(r) if out is None else out.unionByName(fn(r))
    return out


@query("smell_flags", "SN", f"WITH {FLAGGED} SELECT repo, file_path, commit_id, ruleset, {', '.join(op.SMELL_FLAGS + op.SMELL_COUNTS)}, total_smells FROM flags")
def smell_flags(sn):
    return over_rulesets(lambda r: flagged(sn, r).select(*ROW, "ruleset", *op.SMELL_FLAGS, *op.SMELL_COUNTS, "total_smells"))


@query("smell_flags_custom", "SN", f"WITH {METRICS} SELECT repo, file_path, commit_id, ((f1 >= 20)::INT + (f2 >= 20)::INT) AS long_method_count, (max_nesting_depth >= 2)::INT AS has_deep_nesting FROM m")
def smell_flags_custom(sn):
    custom = op.smell_flags(metric_rows(sn), "python", {"long_method": 20, "deep_nesting": 2})
    return custom.select(*ROW, "long_method_count", "has_deep_nesting")


@query(
    "heuristic_risk", "SN",
    f"""WITH {FLAGGED} SELECT repo, file_path, commit_id, ruleset, round(CASE ruleset WHEN 'python' THEN greatest(0.01::DOUBLE, least(0.99::DOUBLE,
  0.25::DOUBLE * least(max_cyclomatic_complexity / 30e0, 1e0) + 0.25::DOUBLE * least(total_smells / 10e0, 1e0) + 0.2::DOUBLE * least(max_nesting_depth / 8e0, 1e0) + 0.15::DOUBLE * least(loc / 1000e0, 1e0) + 0.15::DOUBLE * greatest(0e0, (100 - maintainability_index) / 100)))
WHEN 'java' THEN least(greatest(0.3::DOUBLE * least(total_smells / 5e0, 1e0) + 0.25::DOUBLE * least(max_cyclomatic_complexity / 20e0, 1e0) + 0.2::DOUBLE * least(max_nesting_depth / 6e0, 1e0) + 0.15::DOUBLE * least(loc / 800e0, 1e0)
  + 0.1::DOUBLE * greatest(0e0, (100 - maintainability_index) / 100), 0.05::DOUBLE), 0.95::DOUBLE)
ELSE greatest(0.05::DOUBLE, least(0.95::DOUBLE, 0.22::DOUBLE * has_long_method + 0.18::DOUBLE * has_long_param_list + 0.25::DOUBLE * has_large_class + 0.2::DOUBLE * has_deep_nesting + 0.15::DOUBLE * has_high_complexity
  + CASE WHEN todo_count >= 4 THEN least(0.1::DOUBLE, todo_count * 0.02::DOUBLE) ELSE 0 END)) END, 8) AS risk FROM flags""",
)
def heuristic_risk(sn):
    def risk(r):
        f = flagged(sn, r)
        shared = [F.col(c) for c in ("max_cyclomatic_complexity", "max_nesting_depth", "total_smells", "loc", "maintainability_index")]
        value = {
            "python": lambda: scoring.python_heuristic(*shared, digits=None),
            "java": lambda: scoring.java_heuristic(*shared, digits=None),
            "polyglot": lambda: scoring.polyglot_heuristic(*[F.col(c) for c in op.SMELL_FLAGS], F.col("todo_count")),
        }[r]()
        return f.select(*ROW, "ruleset", F.round(value, 8).alias("risk"))

    return over_rulesets(risk)


def _advice_sql():
    parts = []
    for r in RULESETS:
        for i, (flag, smell, title, severity, action) in enumerate(reporting.ADVICE[r]):
            sev = lit(severity)
            if r == "python" and flag in reporting.PYTHON_HIGH:
                col = {"max_function_size": "greatest(f1, f2)", "max_class_size": "c1", "max_nesting_depth": "max_nesting_depth"}[reporting.PYTHON_HIGH[flag][0]]
                sev = f"CASE WHEN {col} >= {reporting.PYTHON_HIGH[flag][1]} THEN 'high' ELSE 'medium' END"
            parts.append(
                f"SELECT repo, file_path, commit_id, ruleset, {i} AS position, {lit(smell)} AS smell, {lit(title)} AS title, {sev} AS severity, {lit(action)} AS action FROM flags WHERE ruleset = '{r}' AND {flag} = 1"
            )
    return "advice AS (" + " UNION ALL ".join(parts) + ")"


@query("advice_rows", "SN", f"WITH {FLAGGED}, {_advice_sql()} SELECT * FROM advice")
def advice_rows(sn):
    return over_rulesets(lambda r: reporting.advice_rows(flagged(sn, r), r, [*ROW, "ruleset"]))


CAPPED = """a3 AS (SELECT *, row_number() OVER (PARTITION BY repo, commit_id, file_path ORDER BY position) AS rf FROM advice WHERE ruleset = 'polyglot'),
a10 AS (SELECT *, row_number() OVER (PARTITION BY repo, commit_id ORDER BY file_path, position)::INT AS set_position FROM a3 WHERE rf <= 3)"""


def capped(sn):
    return reporting.cap_advice(reporting.advice_rows(flagged(sn, "polyglot"), "polyglot", ROW), ["repo", "commit_id", "file_path"], ["repo", "commit_id"])


@query(
    "advice_cap", "SN",
    f"WITH {FLAGGED}, {_advice_sql()}, {CAPPED} SELECT repo, commit_id, file_path, smell, set_position, set_position <= 6 AS in_report FROM a10 WHERE set_position <= 10",
)
def advice_cap(sn):
    return capped(sn).select("repo", "commit_id", "file_path", "smell", "set_position", "in_report")


def risky(sn, pr):
    return sn.join(pr.select(*ROW, F.col("p_full").alias("risk_probability")), ROW)


RISKY = "rk AS (SELECT s.*, p.p_full AS risk_probability FROM sn_snapshots s JOIN pr_predictions p USING (repo, file_path, commit_id))"


def _findings_sql():
    parts = [
        """SELECT repo, file_path, commit_id, 0 AS ordinal, 'SP-RISK-001' AS rule_id, 'error' AS level, concat('Critical defect risk predicted: ', printf('%.1f', risk_probability * 100), '%. Maintainability: 0.0/100, Max CC: ', printf('%.1f', code_max_cyclomatic_complexity::DOUBLE), '.') AS message FROM rk WHERE risk_probability >= 0.8""",
        """SELECT repo, file_path, commit_id, 0, 'SP-RISK-002', 'warning', concat('High defect risk predicted: ', printf('%.1f', risk_probability * 100), '%. Consider refactoring detected code smells.') FROM rk WHERE risk_probability >= 0.65 AND risk_probability < 0.8""",
    ]
    for i, (flag, rule, text) in enumerate(reporting.SMELL_RULES, 1):
        if flag in ("has_large_class", "has_deep_nesting", "has_high_complexity"):
            parts.append(f"SELECT repo, file_path, commit_id, {i}, '{rule}', 'warning', {lit(text)} FROM rk WHERE {flag} = 1")
    return "\nUNION ALL ".join(parts)


@query("findings", "SN PR", f"WITH {RISKY} {_findings_sql()}")
def findings(sn, pr):
    return reporting.findings(risky(sn, pr))


@query(
    "quality_gate", "SN PR",
    f"""WITH {RISKY} SELECT repo, count(*) FILTER (risk_probability >= 0.99) AS blocked, count(*) FILTER (risk_probability >= 0.65 AND risk_probability < 0.99) AS warned,
  count(*) FILTER (risk_probability < 0.65) AS passed, max(risk_probability) < 0.99 AS gate_passed FROM rk GROUP BY repo""",
)
def quality_gate(sn, pr):
    return reporting.quality_gate(risky(sn, pr), 0.99)


TIER5 = """CASE WHEN p <= 0.35 THEN 'Low' WHEN p <= 0.65 THEN 'Medium' WHEN p <= 0.8 THEN 'High' ELSE 'Critical' END"""


@query(
    "risk_tier", "PR",
    f"""SELECT repo, file_path, commit_id, {TIER5} AS predictor, CASE WHEN p < 0.2 THEN 'Low' WHEN p < 0.5 THEN 'Medium' WHEN p < 0.75 THEN 'High' ELSE 'Critical' END AS explain,
  CASE WHEN p < 0.25 THEN 'Low' WHEN p < 0.5 THEN 'Medium' WHEN p < 0.75 THEN 'High' ELSE 'Critical' END AS java, CASE WHEN p < 0.25 THEN 'Low' WHEN p < 0.6 THEN 'Medium' WHEN p < 0.8 THEN 'High' ELSE 'Critical' END AS change_set,
  CASE WHEN p < 0.2 THEN 'Low' WHEN p < 0.5 THEN 'Medium' WHEN p < 0.75 THEN 'High' ELSE 'Critical' END AS polyglot FROM (SELECT *, p_full AS p FROM pr_predictions)""",
)
def risk_tier(pr):
    return pr.select(*ROW, *[scoring.risk_tier(F.col("p_full"), s).alias(s) for s in scoring.TIER_SCALES])


@query("tier_counts", "PR", f"SELECT {TIER5} AS tier, count(*) AS files, round(count(*) * 100 / (SELECT count(*) FROM pr_predictions), 8) AS pct FROM (SELECT *, p_full AS p FROM pr_predictions) GROUP BY 1")
def tier_counts(pr):
    return rounded(reporting.tier_counts(pr.withColumn("risk_probability", F.col("p_full"))))


@query(
    "pr_rollup", "SN PR",
    f"""WITH {RISKY}, a AS (SELECT repo, commit_id, count(*) AS analyzed_files, avg(risk_probability) AS r, sum(total_smells)::BIGINT AS total_smells FROM rk GROUP BY 1, 2)
SELECT repo, commit_id, analyzed_files, round(r, 8) AS overall_risk_probability, CASE WHEN r < 0.25 THEN 'Low' WHEN r < 0.6 THEN 'Medium' WHEN r < 0.8 THEN 'High' ELSE 'Critical' END AS overall_risk_tier,
  CASE WHEN r < 0.25 THEN 'APPROVE' WHEN r < 0.6 THEN 'COMMENT' ELSE 'REQUEST_CHANGES' END AS verdict, total_smells FROM a""",
)
def pr_rollup(sn, pr):
    return rounded(reporting.change_set_rollup(risky(sn, pr), ["repo", "commit_id"]))


@query(
    "change_set_report", "SN PR",
    f"""WITH {RISKY}, {FLAGGED}, {_advice_sql()}, {CAPPED},
hd AS (SELECT repo, commit_id, count(*) AS n, max(risk_probability) AS top FROM rk GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN risk_probability <= 0.35 THEN 'Low' WHEN risk_probability <= 0.65 THEN 'Medium' WHEN risk_probability <= 0.8 THEN 'High' ELSE 'Critical' END AS tier FROM rk)
SELECT repo, commit_id, 0 AS section, '0' AS ordinal, '## Quality Gate & Defect Risk Report' AS line FROM hd
UNION ALL SELECT repo, commit_id, 0, '1', CASE WHEN top >= 0.8 THEN '🔴 **CRITICAL DEFECT RISK DETECTED**' WHEN top >= 0.65 THEN '🟠 **HIGH DEFECT RISK — REVIEW ADVISED**' ELSE '🟢 **LOW DEFECT RISK — CODEBASE HEALTHY**' END FROM hd
UNION ALL SELECT repo, commit_id, 0, '2', concat('Analyzed **', n, '** modified file(s)') FROM hd
UNION ALL SELECT repo, commit_id, 0, '3', '| File | Defect Risk | Risk Tier | Smells | Status |' FROM hd UNION ALL SELECT repo, commit_id, 0, '4', '|:-----|:-----------:|:---------:|:------:|:------:|' FROM hd
UNION ALL SELECT repo, commit_id, 1, file_path, concat('| `', file_path, '` | **', printf('%.1f', risk_probability * 100), '%** | ', CASE tier WHEN 'Low' THEN '🟢' WHEN 'Medium' THEN '🟡' WHEN 'High' THEN '🟠' ELSE '🔴' END, ' ', tier, ' | ', total_smells, ' | ',
  CASE WHEN risk_probability >= 0.8 THEN '❌ Blocked' WHEN risk_probability >= 0.65 THEN '⚠️ Warning' ELSE '✅ Passed' END, ' |') FROM t
UNION ALL SELECT repo, commit_id, 2, lpad(set_position::VARCHAR, 3, '0'), concat('- **', title, '** in `', file_path, '`: ', action) FROM a10 WHERE set_position <= 6""",
)
def change_set_report(sn, pr):
    return reporting.change_set_report(risky(sn, pr), capped(sn), ["repo", "commit_id"])
