"""Filters, identity, guards, set operations and statistics on snapshot tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.functions import files
from faultline.operators.running import day_level, ranked

MIN_ROWS, LOW_RATE, HIGH_RATE = 50, 0.05, 0.65


# -- projections and filters -------------------------------------------------

def keep_paths(df, language="python"):
    return df.where(~files.path_excluded(F.col("file_path"), language))


def pick_path(df, suffix=".py"):
    """file_path = the new path, else the old one; rows without the suffix are dropped."""
    return df.withColumn("file_path", F.coalesce("new_path", "old_path")).where(F.col("file_path").endswith(suffix))


def cap_size(sources, limit=files.MAX_SOURCE_BYTES):
    return sources.where(files.fits_size(F.col("source"), limit))


def classify_files(sources):
    """File class, with metrics and risk nulled where the class has none."""
    kind = files.file_class(F.col("file_path"))
    lines = F.size(F.split(F.regexp_replace("source", r"\n$", ""), "\n"))
    return sources.select(
        "*",
        kind.alias("file_class"),
        F.when(kind == "python", "python").when(kind == "polyglot", files.language_of(F.col("file_path"))).otherwise(kind).alias("language"),
        F.when(kind == "binary", 0).otherwise(lines).alias("loc"),
        (kind == "python").alias("is_ml_prediction"),
        F.when(kind == "python", "normal").when(kind == "binary", "non_code_file").otherwise("unsupported_language").alias("guardrail_status"),
    )


def native_guardrail(sources):
    """Advisory per file: the repository holds Rust, else C/C++ files, else the source imports native bindings."""
    path = F.col("file_path")
    per_repo = sources.groupBy("repo").agg(
        F.bool_or(path.endswith(".rs") | path.contains("Cargo.toml")).alias("has_rust"),
        F.bool_or(path.endswith(".c") | path.endswith(".cpp") | path.endswith(".pyx")).alias("has_native"),
    )
    reason = (
        F.when(F.col("has_rust"), "rust")
        .when(F.col("has_native"), "native")
        .when(files.native_import(F.col("source")), "bindings")
        .otherwise("none")
    )
    return sources.join(per_repo, "repo").withColumn("reason", reason).withColumn(
        "guardrail", F.when(F.col("reason") == "none", "normal").otherwise("advisory")
    ).drop("has_rust", "has_native")


def route_engine(snapshots, telemetry, mode="auto"):
    """engine = full for tracked files, static otherwise; mode full_only / static_only overrides."""
    tracked = telemetry.select("repo", "file_path").distinct().withColumn("is_tracked", F.lit(True))
    routed = snapshots.join(tracked, ["repo", "file_path"], "left")
    auto = F.when(F.coalesce("is_tracked", F.lit(False)), "full").otherwise("static")
    engine = {"auto": auto, "full_only": F.lit("full"), "static_only": F.lit("static")}[mode]
    return routed.withColumn("engine", engine).withColumn("is_tracked", F.coalesce("is_tracked", F.lit(False)))


def guard_filter(df):
    """Rows fit for training: not excluded, then not an outlier."""
    return df.where((F.col("exclude_from_training") != 1) & (F.col("label_outlier") != 1))


def guard_counts(df):
    excluded = F.col("exclude_from_training") == 1
    outlier = ~excluded & (F.col("label_outlier") == 1)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(excluded).alias("excluded_small"),
        F.count_if(outlier).alias("excluded_outlier"),
        F.count_if(~excluded & ~outlier).alias("kept"),
    )


def valid_labels(df, label="future_bug_fix"):
    return df.where(F.col(label).isin(0, 1)).withColumn(label, F.col(label).cast("int"))


def project_features(df, group_columns, removed=(), keep=()):
    """The columns of a feature group that exist in df, minus the removed ones."""
    return df.select(*keep, *[c for c in group_columns if c in df.columns and c not in set(removed)])


def zero_fill(df, columns):
    """Nulls to 0; columns that are missing are added as 0."""
    have = [F.coalesce(F.col(c), F.lit(0)).alias(c) if c in columns else F.col(c) for c in df.columns]
    return df.select(*have, *[F.lit(0).alias(c) for c in columns if c not in df.columns])


def nest_features(df):
    """Flat snapshot columns as structs code, smells, history."""
    code = [c for c in df.columns if c.startswith("code_")]
    smells = [c for c in df.columns if c.startswith("has_") or c.endswith("_smells")]
    rest = [c for c in df.columns if c not in code + smells]
    return df.select(
        *rest,
        F.struct(*[F.col(c).alias(c[5:]) for c in code]).alias("code"),
        F.struct(*smells).alias("smells"),
    )


def flatten_features(df):
    """Nested structs to flat columns; fields of `code` get the prefix code_."""
    out = []
    for field in df.schema.fields:
        if field.dataType.typeName() == "struct":
            prefix = "code_" if field.name == "code" else ""
            out += [F.col(f"{field.name}.{c}").alias(prefix + c) for c in field.dataType.names]
        else:
            out.append(F.col(field.name))
    return df.select(*out)


# -- identity, upsert, skip, dedup ---------------------------------------------

def upsert(old, new, key):
    """Insert or replace by key: the new row wins. One aggregate, so copies of a key combine map-side."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    rest = [c for c in old.columns if c not in key]
    newest = F.max(F.struct("_batch", *rest))
    return both.groupBy(*key).agg(newest.alias("_row")).select(*key, *[F.col(f"_row.{c}") for c in rest])


def skip_done(todo, done, key="repo"):
    return todo.join(done.select(key).distinct(), key, "left_anti")


def dedup(df, key, order):
    """The first row per key in the given order, by one map-side combined aggregate."""
    rest = [c for c in df.columns if c not in key and c not in order]
    first = F.min(F.struct(*order, *rest))
    return df.groupBy(*key).agg(first.alias("_row")).select(
        *key, *[F.col(f"_row.{c}") for c in df.columns if c not in key]
    )


def union_repos(frames):
    result = frames[0]
    for f in frames[1:]:
        result = result.unionByName(f, allowMissingColumns=True)
    return result


# -- sampling over history ---------------------------------------------------------

def even_sample(commits, cap=500, floor_index=False):
    """Evenly spaced commits of each repository: positions round(i*(n-1)/(cap-1)), or floored."""
    placed = ranked(
        commits.withColumn("_ts", F.unix_timestamp("commit_date")),
        ["repo"], [day_level(F.col("_ts"))], ["_ts", "commit_id"], "_pos",
    ).withColumn("_pos", F.col("_pos") - 1)
    sizes = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("_n"))
    step = (F.col("_n") - 1) / F.lit(float(cap - 1))
    # the candidate i for a position is near pos/step; one of the three neighbours hits it or none does
    near = F.round(F.col("_pos") / step).cast("long")

    def position(i):
        exact = i * (F.col("_n") - 1) / F.lit(float(cap - 1))
        return F.floor(exact) if floor_index else F.rint(exact).cast("long")

    hit = F.lit(False)
    for d in (-1, 0, 1):
        i = near + d
        hit = hit | ((i >= 0) & (i <= cap - 1) & (position(i) == F.col("_pos")))
    return placed.join(sizes, "repo").where((F.col("_n") <= cap) | hit).select(
        *commits.columns, F.col("_pos").alias("position")
    )


def newest_per_key(df, key, order, n):
    """The newest n rows per key; Spark cuts each group to n rows before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def seeded_sample(df, id_column, n=1000, seed=42):
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_column).cast("string"))), id_column).limit(n)


# -- aggregates ----------------------------------------------------------------------

def dataset_stats(snapshots):
    return snapshots.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.countDistinct("repo").alias("repos"),
        F.countDistinct("canonical_file_id").alias("unique_files"),
        F.sum("future_bug_fix").cast("long").alias("positive_labels"),
        F.round(F.sum("future_bug_fix") * 100.0 / F.count(F.lit(1)), 2).alias("positive_rate_pct"),
        F.date_format(F.min("commit_date"), "yyyy-MM-dd").alias("earliest_snapshot"),
        F.date_format(F.max("commit_date"), "yyyy-MM-dd").alias("latest_snapshot"),
    )


def repo_summary(snapshots):
    return snapshots.groupBy("repo").agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.sum("future_bug_fix").cast("long").alias("bug_fix_snapshots"),
        F.round(F.avg("future_bug_fix") * 100, 1).alias("bug_fix_pct"),
        F.round(F.avg("code_loc"), 1).alias("mean_loc"),
        F.round(F.avg("total_smells"), 1).alias("mean_smells"),
    )


def tier_of(df, tiers, default="tier1"):
    """Attach the tier of each repository; `tiers` is a small (repo, tier) table."""
    return df.join(tiers, "repo", "left").withColumn("tier", F.coalesce("tier", F.lit(default)))


def mining_progress(snapshots, tiers):
    """Rows, positives and rate per (tier, repo), per tier and overall, with finished / target repositories per tier."""
    per_repo = snapshots.groupBy("repo").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("future_bug_fix").cast("long").alias("positives"),
        F.sum("parse_fallback").cast("long").alias("fallbacks"),
    )
    rolled = tier_of(per_repo, tiers).rollup("tier", "repo").agg(
        F.sum("rows").alias("rows"), F.sum("positives").alias("positives"),
        F.sum("fallbacks").alias("fallbacks"), F.count(F.lit(1)).alias("done"),
    )
    targets = tiers.rollup("tier").agg(F.count(F.lit(1)).alias("target"))
    rate = F.col("positives") * 100 / F.col("rows")
    return rolled.join(targets.withColumnRenamed("tier", "_t"), F.col("tier").eqNullSafe(F.col("_t")), "left").select(
        F.coalesce("tier", F.lit("all")).alias("tier"),
        F.coalesce("repo", F.lit("all")).alias("repo"),
        "rows", "positives", rate.alias("positive_pct"), (F.col("fallbacks") * 100 / F.col("rows")).alias("fallback_pct"),
        "done", F.coalesce("target", F.lit(0)).alias("target"),
    )


def repo_guards(snapshots, min_rows=MIN_ROWS, low=LOW_RATE, high=HIGH_RATE):
    """Flag repositories too small or with a label rate out of range, on every row.

    The counts come from an aggregate joined back, not a window, so a large
    repository is never gathered in one task.
    """
    stats = snapshots.groupBy("repo").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("future_bug_fix").alias("_rate")
    ).select(
        "repo",
        (F.col("_n") < min_rows).cast("int").alias("exclude_from_training"),
        ((F.col("_rate") < low) | (F.col("_rate") > high)).cast("int").alias("label_outlier"),
    )
    return snapshots.join(stats, "repo")


def distribution_check(snapshots, columns):
    """Per column: min, max, mean, sample deviation, zero-variance flag; date span of the table."""
    entries = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    )
    return snapshots.select("commit_date", entries.alias("e")).groupBy(F.col("e.column").alias("column")).agg(
        F.min("e.v").alias("min"), F.max("e.v").alias("max"), F.avg("e.v").alias("mean"),
        F.stddev_samp("e.v").alias("std"),
        (F.max("e.v") == F.min("e.v")).alias("zero_variance"),
        F.date_diff(F.max("commit_date"), F.min("commit_date")).alias("span_days"),
    )


def zero_variance(df, columns):
    """Columns whose values never vary, one scan."""
    spread = df.agg(*[F.max(c).eqNullSafe(F.min(c)).alias(c) for c in columns])
    return spread.select(F.explode(F.array(*[F.when(F.col(c), F.lit(c)) for c in columns])).alias("column")).where(
        F.col("column").isNotNull()
    )


# Smell, column, thresholds of the sensitivity table.
SENSITIVITY_GRID = [
    ("Long Method", "code_loc", [30, 40, 50, 60, 80]),
    ("Long Param List", "code_sloc", [10, 20, 30, 50, 100]),
    ("Large Class", "code_loc", [100, 200, 300, 500, 1000]),
    ("Deep Nesting", "code_max_nesting_depth", [3, 5, 8, 12, 20]),
    ("High Complexity", "code_max_cyclomatic_complexity", [7, 10, 15, 20, 30]),
]


def sensitivity(snapshots, grid=None, label="future_bug_fix"):
    """Per (smell, threshold): flagged rows, their label rate in percent, correlation of flag and label.

    Every cell is a conditional aggregate, so the table is read once however large the grid is.
    """
    cells = [(s, c, t) for s, c, ts in (grid or SENSITIVITY_GRID) if c in snapshots.columns for t in ts]
    y = F.col(label).cast("double")
    n, sy = F.count(F.lit(1)).cast("double"), F.sum(y)
    parts = []
    for k, (_, column, t) in enumerate(cells):
        active = F.coalesce(F.col(column), F.lit(0)) >= t
        na, say = F.count_if(active).cast("double"), F.coalesce(F.sum(F.when(active, y)), F.lit(0.0))
        # correlation from sums, as a flag that never varies must give 0 and not an error
        spread = F.sqrt((n * na - na * na) * (n * F.sum(y * y) - sy * sy))
        parts += [
            F.count_if(active).alias(f"n{k}"),
            F.avg(F.when(active, y)).alias(f"rate{k}"),
            F.try_divide(n * say - sy * na, spread).alias(f"r{k}"),
        ]
    wide = snapshots.agg(*parts)
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("smell"), F.lit(t).alias("threshold"), F.col(f"n{k}").alias("active_snapshots"),
                (F.coalesce(F.col(f"rate{k}"), F.lit(0.0)) * 100).alias("active_bug_rate"),
                F.coalesce(F.col(f"r{k}"), F.lit(0.0)).alias("defect_correlation"),
            )
            for k, (s, _, t) in enumerate(cells)
        ]
    )
    return wide.select(F.inline(rows))
