"""Advice, findings, gates, change-set roll-ups and document lines."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators.scoring import icon_of, risk_tier

# Advice per rule set and smell: flag, smell, title, severity, action.
ADVICE = {
    "polyglot": [
        ("has_long_method", "Long Method", "Extract Method", "Medium", "Decompose long routines into modular, single-responsibility sub-functions."),
        ("has_long_param_list", "Long Parameter List", "Introduce Parameter Object", "Medium", "Encapsulate multiple related arguments into a structured data object or DTO."),
        ("has_large_class", "Large Class", "Separate Concerns", "High", "Extract secondary responsibilities (I/O, formatting, validation) into helper classes."),
        ("has_deep_nesting", "Deep Nesting", "Introduce Guard Clauses", "High", "Replace nested if-statements with early returns and inverted checks."),
        ("has_high_complexity", "High Complexity", "Simplify Branching Logic", "High", "Replace complex conditional logic with polymorphism or lookup tables."),
    ],
    "java": [
        ("has_long_method", "Long Method", "Extract Helper Method", "high", "Decompose large methods into private static or instance helper methods."),
        ("has_long_param_list", "Long Parameter List", "Introduce Parameter Object (DTO/Record)", "medium", "Encapsulate multiple related parameters into a Java record or builder POJO."),
        ("has_deep_nesting", "Deep Nesting", "Introduce Guard Clauses", "high", "Invert nested if-conditions and return early at the top of the method."),
        ("has_large_class", "Large Class", "Extract Delegate / Service Class", "high", "Apply Single Responsibility Principle (SRP) to decompose into cohesive service delegates."),
    ],
    "python": [
        ("has_long_method", "LongMethod", "Extract Method", "medium", "Decompose into cohesive private helper functions (Extract Method refactoring)."),
        ("has_long_param_list", "LongParameterList", "Introduce Parameter Object", "medium", "Wrap parameters into a dedicated dataclass or TypedDict."),
        ("has_large_class", "LargeClass", "Extract Sub-Class", "medium", "Group cohesive methods and state into smaller helper classes or strategy delegates."),
        ("has_deep_nesting", "DeepNesting", "Flatten Deep Nesting", "medium", "Use Guard Clauses (Early Returns) or dispatch mapping to flatten nested branches."),
    ],
}

# Python severities rise from medium to high at these sizes: the column must be present for it.
PYTHON_HIGH = {
    "has_long_method": ("max_function_size", 100), "has_large_class": ("max_class_size", 500), "has_deep_nesting": ("max_nesting_depth", 6),
}

# Finding rule ids and texts.
SMELL_RULES = [
    ("has_long_method", "SP-SMELL-001", "Long Method smell detected (LOC exceeds threshold)."),
    ("has_long_param_list", "SP-SMELL-002", "Long Parameter List detected (>= 5 parameters)."),
    ("has_large_class", "SP-SMELL-003", "Large Class smell detected (Class LOC >= 300)."),
    ("has_deep_nesting", "SP-SMELL-004", "Deep Nesting detected (Control flow depth >= 4)."),
    ("has_high_complexity", "SP-SMELL-005", "High Cyclomatic Complexity detected (CC >= 10)."),
]
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def _present(entries):
    """Explode the non-null structs of an array."""
    return F.inline(F.filter(F.array(*entries), lambda x: x.isNotNull()))


def advice_rows(flags, ruleset, keep):
    """One row per smell present: keep columns, position, smell, title, severity, action."""
    entries = []
    for i, (flag, smell, title, severity, action) in enumerate(ADVICE[ruleset]):
        if flag not in flags.columns:
            continue
        level = F.lit(severity)
        if ruleset == "python" and flag in PYTHON_HIGH and PYTHON_HIGH[flag][0] in flags.columns:
            column, bound = PYTHON_HIGH[flag]
            level = F.when(F.col(column) >= bound, "high").otherwise("medium")
        entries.append(
            F.when(
                F.col(flag) == 1,
                F.struct(
                    F.lit(i).alias("position"), F.lit(smell).alias("smell"), F.lit(title).alias("title"), level.alias("severity"), F.lit(action).alias("action")
                ),
            )
        )
    return flags.select(*keep, _present(entries))


def cap_advice(advice, file_key, set_key, per_file=3, per_set=10, per_report=6):
    """Advice kept for review: the first per_file of each file, of these the first per_set of each change set;
    in_report marks the first per_report of each set. Row-number bounds cut groups before the shuffle."""
    by_file = Window.partitionBy(*file_key).orderBy("position")
    by_set = Window.partitionBy(*set_key).orderBy(*[c for c in file_key if c not in set_key], "position")
    first = advice.withColumn("_f", F.row_number().over(by_file)).where(F.col("_f") <= per_file).drop("_f")
    placed = first.withColumn("set_position", F.row_number().over(by_set)).where(F.col("set_position") <= per_set)
    return placed.withColumn("in_report", F.col("set_position") <= per_report)


def findings(files):
    """Rows (repo, file_path, commit_id, rule_id, level, message): risk first, then one per smell flag."""
    risk = F.col("risk_probability")
    percent = F.format_string("%.1f", risk * 100)
    mi = F.col("maintainability_index") if "maintainability_index" in files.columns else F.lit(0.0)
    cc = F.col("code_max_cyclomatic_complexity") if "code_max_cyclomatic_complexity" in files.columns else F.lit(0)

    def row(ordinal, rule, level, message):
        return F.struct(F.lit(ordinal).alias("ordinal"), F.lit(rule).alias("rule_id"), F.lit(level).alias("level"), message.alias("message"))

    critical = F.concat(
        F.lit("Critical defect risk predicted: "), percent, F.lit("%. Maintainability: "), F.format_string("%.1f", mi.cast("double")),
        F.lit("/100, Max CC: "), F.format_string("%.1f", cc.cast("double")), F.lit("."),
    )
    high = F.concat(F.lit("High defect risk predicted: "), percent, F.lit("%. Consider refactoring detected code smells."))
    entries = [
        F.when(risk >= 0.80, row(0, "SP-RISK-001", "error", critical)).when(risk >= 0.65, row(0, "SP-RISK-002", "warning", high))
    ]
    for i, (flag, rule, text) in enumerate(SMELL_RULES, 1):
        if flag in files.columns:
            entries.append(F.when(F.col(flag) == 1, row(i, rule, "warning", F.lit(text))))
    uri = F.replace("file_path", F.lit("\\"), F.lit("/"))
    return files.select("repo", uri.alias("file_path"), "commit_id", _present(entries))


def gate_status(risk, fail_under=0.80):
    return F.when(risk >= fail_under, "Blocked").when(risk >= 0.65, "Warning").otherwise("Passed")


def quality_gate(files, fail_under=0.80):
    """Per repository: files per status and whether the gate holds."""
    return files.withColumn("_status", gate_status(F.col("risk_probability"), fail_under)).groupBy("repo").agg(
        F.count_if(F.col("_status") == "Blocked").alias("blocked"), F.count_if(F.col("_status") == "Warning").alias("warned"),
        F.count_if(F.col("_status") == "Passed").alias("passed"), (~F.bool_or(F.col("risk_probability") >= fail_under)).alias("gate_passed"),
    )


def tier_counts(files, scale="predictor"):
    """Files per tier with their share of all files in percent."""
    per_tier = files.groupBy(risk_tier(F.col("risk_probability"), scale).alias("tier")).agg(F.count(F.lit(1)).alias("files"))
    total = per_tier.agg(F.sum("files").alias("n")).scalar()
    return per_tier.withColumn("pct", F.col("files") * 100 / total)


def change_set_rollup(files, key):
    """Per change set: files, mean risk, tier, verdict, smells."""
    rolled = files.groupBy(*key).agg(
        F.count(F.lit(1)).alias("analyzed_files"), F.avg("risk_probability").alias("_risk"), F.sum("total_smells").cast("long").alias("total_smells")
    )
    tier = risk_tier(F.col("_risk"), "change_set")
    verdict = F.when(F.col("_risk") < 0.25, "APPROVE").when(F.col("_risk") < 0.60, "COMMENT").otherwise("REQUEST_CHANGES")
    return rolled.select(
        *key, "analyzed_files", F.col("_risk").alias("overall_risk_probability"), tier.alias("overall_risk_tier"), verdict.alias("verdict"), "total_smells"
    )


def change_set_report(files, advice, key, fail_under=0.80):
    """Markdown lines of each change set's report: rows (*key, section, ordinal, line).

    A change set may be of any size, so the report is a table of lines ordered by
    (section, ordinal) and never one collected string; sources.sinks writes it as text.
    """
    risk = F.col("risk_probability")
    heads = files.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(risk >= 0.80).alias("critical"), F.bool_or(risk >= 0.65).alias("high")
    )
    badge = (
        F.when(F.col("critical"), "🔴 **CRITICAL DEFECT RISK DETECTED**")
        .when(F.col("high"), "🟠 **HIGH DEFECT RISK — REVIEW ADVISED**")
        .otherwise("🟢 **LOW DEFECT RISK — CODEBASE HEALTHY**")
    )

    def lines(section, *texts):
        return [F.struct(F.lit(section).alias("section"), F.lit(str(i)).alias("ordinal"), t.alias("line")) for i, t in enumerate(texts)]

    top = heads.select(
        *key,
        F.inline(F.array(*lines(
            0, F.lit("## Quality Gate & Defect Risk Report"), badge,
            F.concat(F.lit("Analyzed **"), F.col("n").cast("string"), F.lit("** modified file(s)")),
            F.lit("| File | Defect Risk | Risk Tier | Smells | Status |"), F.lit("|:-----|:-----------:|:---------:|:------:|:------:|"),
        ))),
    )
    tier = risk_tier(risk)
    status = F.when(risk >= fail_under, "❌ Blocked").when(risk >= 0.65, "⚠️ Warning").otherwise("✅ Passed")
    body = files.select(
        *key, F.lit(1).alias("section"), F.col("file_path").alias("ordinal"),
        F.concat(
            F.lit("| `"), "file_path", F.lit("` | **"), F.format_string("%.1f", risk * 100), F.lit("%** | "), icon_of(tier), F.lit(" "), tier,
            F.lit(" | "), F.col("total_smells").cast("string"), F.lit(" | "), status, F.lit(" |"),
        ).alias("line"),
    )
    tips = advice.where("in_report").select(
        *key, F.lit(2).alias("section"), F.lpad(F.col("set_position").cast("string"), 3, "0").alias("ordinal"),
        F.concat(F.lit("- **"), "title", F.lit("** in `"), "file_path", F.lit("`: "), "action").alias("line"),
    )
    return top.unionByName(body).unionByName(tips)


def sarif_lines(found, tool="faultline", version="1.0.0"):
    """SARIF 2.1.0 documents, one per repository, as ordered lines (repo, section, ordinal, line).

    One line per result: a repository's document is spread over tasks and files in
    order, and reading them in order gives one valid document. Results are written
    with a leading comma, after a first empty rule list entry closes the header.
    """
    rules = "[" + ",".join('{"id":"%s"}' % r for r in ["SP-RISK-001", "SP-RISK-002"] + [r for _, r, _ in SMELL_RULES]) + "]"
    header = '{"$schema":"%s","version":"2.1.0","runs":[{"tool":{"driver":{"name":"%s","version":"%s","rules":%s}},"results":[' % (
        SARIF_SCHEMA, tool, version, rules
    )
    ordinal = F.concat_ws("|", "file_path", F.lpad(F.col("commit_id").cast("string"), 20, "0"), F.col("ordinal").cast("string"))
    result = F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
            F.array(
                F.struct(
                    F.struct(
                        F.struct(F.col("file_path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
                        F.struct(F.lit(1).alias("startLine"), F.lit(1).alias("startColumn")).alias("region"),
                    ).alias("physicalLocation")
                )
            ).alias("locations"),
        )
    )
    rows = found.select("repo", F.lit(1).alias("section"), ordinal.alias("ordinal"), result.alias("_json"))
    first = rows.groupBy("repo").agg(F.min("ordinal").alias("_first"))
    body = rows.join(first, "repo").select(
        "repo", "section", "ordinal",
        F.when(F.col("ordinal") == F.col("_first"), F.col("_json")).otherwise(F.concat(F.lit(","), "_json")).alias("line"),
    )
    ends = first.select(
        "repo",
        F.inline(F.array(
            F.struct(F.lit(0).alias("section"), F.lit("").alias("ordinal"), F.lit(header).alias("line")),
            F.struct(F.lit(2).alias("section"), F.lit("").alias("ordinal"), F.lit("]}]}").alias("line")),
        )),
    )
    return body.unionByName(ends)
