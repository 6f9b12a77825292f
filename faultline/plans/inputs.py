"""Commit, change, snapshot, prediction, annotation and source tables.

The six inputs are SQL over the given tables. The same text runs in Spark and,
as leading CTEs, in the check engine, so both sides start from equal rows.
"""

VIEWS = {
    "c_commits": """
SELECT o_orderkey AS commit_id,
       concat('repo', cast(o_custkey % 8 AS string)) AS repo,
       concat('dev', cast(o_custkey % 23 AS string)) AS author,
       o_orderdate AS commit_date,
       CASE o_orderkey % 16
         WHEN 0 THEN 'Fix null pointer exception in core.py (#1234)'
         WHEN 1 THEN 'Add new feature: user authentication'
         WHEN 2 THEN 'Fix crash when input is empty'
         WHEN 3 THEN 'Merge pull request #42 from dev/feature-branch'
         WHEN 4 THEN 'Refactor database connection logic'
         WHEN 5 THEN 'bug fix: resolved issue with timeout regression'
         WHEN 6 THEN 'Update documentation for API endpoints'
         WHEN 7 THEN 'hotfix: patch for broken login endpoint'
         WHEN 8 THEN 'Merge and format code style fix'
         WHEN 9 THEN 'Resolves #999: edge case in parser'
         WHEN 10 THEN 'KAFKA-123 handle broker shutdown'
         WHEN 11 THEN 'patch by dev1; reviewed by dev2'
         WHEN 12 THEN 'resolve memory leak in file parser'
         WHEN 13 THEN 'Bump version to 2.1'
         WHEN 14 THEN 'fix typo in comment'
         ELSE 'Improve test coverage for utils module' END AS message
FROM orders""",
    "fc_file_changes": """
SELECT c.repo, c.commit_id, c.author, c.commit_date, c.message,
       concat('src/mod', cast(l.l_partkey % 60 AS string),
         CASE l.l_partkey % 6 WHEN 0 THEN '.java' WHEN 1 THEN '.ts' WHEN 2 THEN '/tests/a.py' ELSE '.py' END) AS file_path,
       cast(sum(l.l_quantity) AS int) AS lines
FROM lineitem l JOIN c_commits c ON l.l_orderkey = c.commit_id
GROUP BY 1, 2, 3, 4, 5, 6""",
    "sn_snapshots": """
SELECT *, CASE WHEN code_loc >= 300 THEN 1 ELSE 0 END AS has_large_class,
       CASE WHEN code_max_cyclomatic_complexity >= 10 THEN 1 ELSE 0 END AS has_high_complexity,
       CASE WHEN code_max_nesting_depth >= 4 THEN 1 ELSE 0 END AS has_deep_nesting,
       CASE WHEN code_loc >= 300 THEN 1 ELSE 0 END + CASE WHEN code_max_cyclomatic_complexity >= 10 THEN 1 ELSE 0 END
         + CASE WHEN code_max_nesting_depth >= 4 THEN 1 ELSE 0 END AS total_smells
FROM (SELECT repo, file_path, commit_id, commit_date,
       substring(md5(concat(repo, '::', file_path)), 1, 12) AS canonical_file_id,
       20 + (commit_id * 37 + lines * 11) % 900 AS code_loc,
       1 + (commit_id * 7 + lines) % 25 AS code_max_cyclomatic_complexity,
       1 + commit_id % 7 AS code_max_nesting_depth,
       CASE WHEN (commit_id * 13 + lines * 5) % 100 < 35 THEN 1 ELSE 0 END AS future_bug_fix
      FROM fc_file_changes) s""",
    "pr_predictions": """
SELECT repo, file_path, commit_id, future_bug_fix AS y,
       cast((code_loc * 13 + code_max_cyclomatic_complexity * 101 + future_bug_fix * 250) % 1000 AS double) / 1000e0 AS p_full,
       cast((code_loc * 29 + future_bug_fix * 150) % 1000 AS double) / 1000e0 AS p_static
FROM sn_snapshots""",
    "an_annotations": """
SELECT commit_id, message, o_orderkey % 16 IN (0, 2, 5, 7, 9, 12) AS human_label
FROM c_commits JOIN orders ON o_orderkey = commit_id""",
    "src_sources": """
SELECT concat('repo', cast(p_partkey % 8 AS string)) AS repo,
       concat('src/f', cast(p_partkey AS string), CASE p_partkey % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.go' WHEN 2 THEN '.py' ELSE '.md' END) AS file_path,
       CASE WHEN p_partkey % 4 IN (0, 1)
         THEN concat('/* header', chr(10), 'TODO later */', chr(10), 'class A {', chr(10),
                repeat(concat('  if (a) {', chr(10)), cast(p_size % 6 AS int)), '  x = y + 1; // note', chr(10),
                repeat(concat('  }', chr(10)), cast(p_size % 6 AS int)), '}', chr(10))
         ELSE concat('# header TODO', chr(10), 'import os', chr(10), 'def f(a, b, c, d, e):', chr(10),
                repeat(concat('    if a:', chr(10)), 1), repeat(concat('        x = 1', chr(10)), cast(1 + p_size AS int)), chr(10), 'class B:', chr(10), '    pass', chr(10)) END AS source
FROM part""",
}

NEEDS = {
    "c_commits": [],
    "fc_file_changes": ["c_commits"],
    "sn_snapshots": ["fc_file_changes"],
    "pr_predictions": ["sn_snapshots"],
    "an_annotations": ["c_commits"],
    "src_sources": [],
}
TABLES = {
    "c_commits": ["orders"],
    "fc_file_changes": ["lineitem"],
    "an_annotations": ["orders"],
    "src_sources": ["part"],
}
SHORT = {
    "C": "c_commits",
    "FC": "fc_file_changes",
    "SN": "sn_snapshots",
    "PR": "pr_predictions",
    "AN": "an_annotations",
    "SRC": "src_sources",
}


def closure(names):
    """The views needed for `names`, in definition order."""
    wanted = set()
    stack = list(names)
    while stack:
        name = stack.pop()
        if name not in wanted:
            wanted.add(name)
            stack.extend(NEEDS[name])
    return [n for n in VIEWS if n in wanted]


def ctes(names):
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in closure(names))


#: What one task works on whatever the size of the tables: rows of the join of orders and lines, and of an exchange its written bytes.
ROWS_A_TASK, BYTES_A_TASK = 250_000, "8m"
#: Sources of one task: a row of a small file is a whole text, whose metrics cost far more than its bytes tell.
SOURCES_A_TASK = 5_000


def sized(spark, rows):
    """Deal exchanges out so that a task's share does not grow with the input; returns the number of parts for so many rows."""
    parts = max(1, -(-rows // ROWS_A_TASK))
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < parts:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", BYTES_A_TASK)
    return parts


def read(spark, sf_dir, short):
    """One input as a DataFrame; `short` is a key of SHORT. Dates become timestamps in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    name = SHORT[short]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for view in closure([name]) for t in TABLES.get(view, [])}
    if "lineitem" in tables:
        # both sides are dealt out by the order's key; the grouping above the join keeps to these parts
        parts = sized(spark, tables["lineitem"].count())
        tables["lineitem"] = tables["lineitem"].repartition(parts, "l_orderkey")
        tables["orders"] = tables["orders"].repartition(parts, "o_orderkey")
    if "part" in tables:
        tables["part"] = tables["part"].repartition(max(1, -(-tables["part"].count() // SOURCES_A_TASK)))
    for table, rows in tables.items():
        rows.createOrReplaceTempView(table)
    df = spark.sql(f"WITH {ctes([name])}\nSELECT * FROM {name}")
    if "commit_date" in df.columns:
        df = df.withColumn("commit_date", df["commit_date"].cast("timestamp"))
    return df


def oracle(shorts, body):
    """Check-engine SQL: the views as CTEs, then `body` (which may open with its own WITH)."""
    body = body.strip()
    names = [SHORT[s] for s in shorts]
    if not names:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes(names)},\n{body[5:]}"
    return f"WITH {ctes(names)}\n{body}"
