"""Features derived from snapshot tables: trends, ages, ranks, relatives, co-change, ownership, vectors."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators.rank_walk import ranked_rows
from faultline.operators.running import DAY, day_level, exact_quantiles, running

FILE = ["repo", "file_path"]

# Feature names by family and the groups made of them.
CODE = [
    "code_loc", "code_sloc", "code_comment_density", "code_function_count", "code_class_count", "code_import_count",
    "code_avg_function_size", "code_max_function_size", "code_avg_param_count", "code_max_param_count",
    "code_max_nesting_depth", "code_avg_cyclomatic_complexity", "code_max_cyclomatic_complexity",
    "code_halstead_volume", "code_halstead_difficulty", "code_halstead_effort", "code_halstead_bugs",
    "code_maintainability_index", "code_cognitive_complexity",
]
SMELLS = [
    "has_long_method", "has_long_param_list", "has_large_class", "has_deep_nesting", "has_high_complexity",
    "long_method_count", "long_param_count", "large_class_count", "deep_nesting_count", "high_complexity_count",
    "total_smells",
]
HISTORY = [
    "previous_file_commits", "previous_bug_fixes", "contributors", "recent_file_commits", "file_age_days",
    "days_since_last_change", "developer_experience", "ownership_concentration", "commit_message_entropy",
    "avg_commit_size", "avg_time_between_commits", "has_multiple_contributors", "is_recently_touched",
]
TRAJECTORY = ["smell_delta", "complexity_delta", "smell_trend", "has_smell_increase", "smell_density"]
INTERACTION = ["smells_x_churn", "smells_x_bugs", "complexity_x_churn", "smells_x_age", "bug_rate_x_smells"]
RANKED = [
    "code_loc", "code_sloc", "code_function_count", "code_avg_cyclomatic_complexity", "code_max_cyclomatic_complexity",
    "code_halstead_volume", "code_halstead_difficulty", "code_maintainability_index", "code_cognitive_complexity",
    "total_smells", "long_method_count", "high_complexity_count", "smell_density", "previous_file_commits",
    "previous_bug_fixes", "recent_file_commits", "file_age_days", "days_since_last_change", "avg_commit_size",
    "developer_experience", "ownership_concentration",
]
RELATIVE = [f"rel_{c}" for c in RANKED]
RANK = [f"rank_{c}" for c in RANKED]
SMELL_AGE = [
    "age_has_long_method", "age_has_long_param_list", "age_has_large_class", "age_has_deep_nesting",
    "age_has_high_complexity", "max_smell_age_days", "has_persistent_smell", "persistent_smell_count", "total_smell_age_days",
]
COCHANGE = [
    "cochange_peer_count", "cochange_coupling_ratio", "cochange_peer_complexity_mean", "cochange_peer_loc_mean",
    "rank_cochange_peer_count", "cochange_cluster_size",
]
OWNERSHIP = [
    "contributors", "ownership_concentration", "silo_index", "contributor_annual_rate", "complexity_churn_interaction",
    "rank_contributor_annual_rate", "rank_complexity_churn_interaction",
]
GROUPS = {
    "A": CODE,
    "B": CODE + HISTORY,
    "C": CODE + HISTORY + SMELLS,
    "D": CODE + HISTORY + SMELLS + TRAJECTORY + INTERACTION,
    "E": CODE + HISTORY + SMELLS + TRAJECTORY + INTERACTION + RELATIVE + SMELL_AGE,
    "F": RELATIVE + SMELL_AGE + TRAJECTORY + INTERACTION,
    "G": RANK + SMELL_AGE + TRAJECTORY + INTERACTION,
    "H": RANK + RELATIVE + SMELL_AGE + TRAJECTORY + INTERACTION,
    "I": RANK + RELATIVE + SMELL_AGE + TRAJECTORY + INTERACTION + COCHANGE,
    "J": RANK + RELATIVE + SMELL_AGE + TRAJECTORY + INTERACTION + COCHANGE + OWNERSHIP,
}
STATIC_FEATURES = [
    "code_loc", "code_sloc", "code_function_count", "code_class_count", "code_avg_cyclomatic_complexity",
    "code_max_cyclomatic_complexity", "code_cognitive_complexity", "code_maintainability_index", "code_halstead_volume",
    "code_halstead_difficulty", "code_halstead_bugs", "code_max_nesting_depth", *SMELLS, "smell_density",
    "rank_code_loc", "rank_code_sloc", "rank_code_avg_cyclomatic_complexity", "rank_code_max_cyclomatic_complexity",
    "rank_code_cognitive_complexity", "rank_code_maintainability_index", "rank_code_halstead_volume",
    "rank_code_halstead_difficulty", "rank_total_smells", "rank_smell_density",
]
QUANTILE_FEATURES = [f[5:] for f in STATIC_FEATURES if f.startswith("rank_")]
FORBIDDEN = [
    "future_bug_fix", "has_bug_fix", "future_bug_fix_score", "label_outlier", "exclude_from_training", "parse_fallback",
]


def _stamped(df):
    return df.withColumn("ts", F.unix_timestamp("commit_date"))


def trajectory(snapshots):
    """Change of smells and complexity since the file's previous snapshot, 0 at the first."""
    stamped = _stamped(snapshots).withColumn(
        "_state", F.struct("ts", "commit_id", "total_smells", "code_max_cyclomatic_complexity")
    )
    # the previous row is the greatest state before this one in (time, commit) order
    with_prior = running(stamped, FILE, [day_level(F.col("ts"))], ["ts", "commit_id"], {"_prior": ("max", "_state")})
    delta = F.coalesce(F.col("total_smells") - F.col("_prior.total_smells"), F.lit(0))
    return with_prior.select(
        *snapshots.columns,
        delta.alias("smell_delta"),
        F.coalesce(F.col("code_max_cyclomatic_complexity") - F.col("_prior.code_max_cyclomatic_complexity"), F.lit(0)).alias("complexity_delta"),
        F.signum(delta).cast("int").alias("smell_trend"),
        (delta > 0).cast("int").alias("has_smell_increase"),
        smell_density().alias("smell_density"),
    )


def smell_density():
    return F.col("total_smells") / F.greatest(F.col("code_loc"), F.lit(1))


def interactions(df):
    """Products of smells, complexity and history columns."""
    rate = F.coalesce(F.try_divide(F.col("previous_bug_fixes"), F.col("previous_file_commits")), F.lit(0.0))
    return df.select(
        "*",
        (F.col("total_smells") * F.col("previous_file_commits")).alias("smells_x_churn"),
        (F.col("total_smells") * F.col("previous_bug_fixes")).alias("smells_x_bugs"),
        (F.col("code_max_cyclomatic_complexity") * F.col("recent_file_commits")).alias("complexity_x_churn"),
        (smell_density() * F.col("file_age_days")).alias("smells_x_age"),
        (rate * F.col("total_smells")).alias("bug_rate_x_smells"),
    )


def smell_age(snapshots, flags, persistent_days=90):
    """Days each smell has been present without a break up to the snapshot; 0 when absent now.

    A run starts at a flagged snapshot whose predecessor is not flagged; the
    latest start up to a snapshot is a running maximum.
    """
    level = [day_level(F.col("ts"))]
    order = ["ts", "commit_id"]
    stamped = _stamped(snapshots).withColumn("_state", F.struct("ts", "commit_id", *flags))
    prior = running(stamped, FILE, level, order, {"_prior": ("max", "_state")})
    for f in flags:
        begins = (F.col(f) == 1) & (F.coalesce(F.col(f"_prior.{f}"), F.lit(0)) == 0)
        prior = prior.withColumn(f"_start_{f}", F.when(begins, F.col("ts")))
    started = running(prior, FILE, level, order, {f"_since_{f}": ("max", f"_start_{f}") for f in flags}, inclusive=True)
    age = {f: F.when(F.col(f) == 1, (F.col("ts") - F.col(f"_since_{f}")) / float(DAY)).otherwise(0.0) for f in flags}
    aged = started.select(*snapshots.columns, *[a.alias(f"age_{f}") for f, a in age.items()])
    names = [F.col(f"age_{f}") for f in flags]
    total, persistent = F.lit(0.0), F.lit(0)
    for a in names:
        total = total + a
        persistent = persistent + (a >= persistent_days).cast("int")
    return aged.select(
        "*",
        (F.greatest(*names) if len(names) > 1 else names[0]).alias("max_smell_age_days"),
        total.alias("total_smell_age_days"),
        persistent.alias("persistent_smell_count"),
        (persistent > 0).cast("int").alias("has_persistent_smell"),
    )


def causal_rank(snapshots, columns, key=None):
    """rank_X: share of the repository's snapshots up to the snapshot's time whose X is at most its X.

    Counting pairs would be quadratic per repository: see rank_walk, which sends each snapshot once. A null has no rank; rows that
    share a key share the greatest of their ranks, and those whose key has a null have none.
    """
    key = key or [*FILE, "commit_id"]
    stamped = _stamped(snapshots)
    ranked = ranked_rows(stamped, columns, _level_from_data)
    every = ranked.select("row.*", *[F.col(c).alias(f"rank_{c}") for c in columns])
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    best = Window.partitionBy(*key)
    return every.select(*snapshots.columns, *[F.when(whole, F.max(f"rank_{c}").over(best)).alias(f"rank_{c}") for c in columns])


def _level_from_data(values, parts=256):
    """`values` with `_level`, the part of all values of its feature that x lies in: borders are quantiles of the rows, so a part holds
    about an equal share of them however they crowd. Returns the frame and the level column."""
    borders = values.groupBy("feature").agg(F.percentile_approx("x", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000).alias("b"))
    table = borders.agg(F.map_from_entries(F.collect_list(F.struct("feature", "b")))).scalar()  # a row for each feature
    placed = values.withColumn("_borders", table)
    at = knots_upto(F.element_at(F.col("_borders"), F.col("feature")), F.col("x"))
    return placed.select(*values.columns, at.alias("_level")), F.col("_level")


def knots_upto(knots, x):
    """How many of the sorted `knots` are at most x, by bisection."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(knots) + 1.0)).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(knots).alias("hi"))

    def halve(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = (a["lo"] < a["hi"]) & (F.get(knots, mid) <= x)
        return F.struct(F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(right | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, start, halve, lambda a: a["lo"])


def repo_medians(snapshots, columns):
    """Median of each column per repository, wide."""
    cells = snapshots.select(
        "repo",
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])),
    )
    medians = exact_quantiles(cells, ["repo", "feature"], "x", [0.5])
    return medians.groupBy("repo").agg(
        *[F.max(F.when(F.col("feature") == c, F.col("quantile"))).alias(f"_median_{c}") for c in columns]
    )


def repo_relative(snapshots, columns):
    """rel_X = X / the repository's median of X, 0 where the median is 0."""
    return snapshots.join(repo_medians(snapshots, columns), "repo").select(
        *snapshots.columns,
        *[
            F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"_median_{c}")), F.lit(0.0)).alias(f"rel_{c}")
            for c in columns
        ],
    )


def quantile_reference(df, columns, points=101):
    """Linear quantile table per feature: rows (feature, idx, value)."""
    cells = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    )
    probs = [i / (points - 1) for i in range(points)]
    table = exact_quantiles(cells, ["feature"], "x", probs)
    return table.select("feature", F.round(F.col("prob") * (points - 1)).cast("int").alias("idx"), F.col("quantile").alias("value"))


def quantile_rank(df, columns, table):
    """qrank_X: place of X in its quantile table, interpolated onto [0.01, 0.99]; 0.5 without a table or a value.

    A table may have any number of knots, evenly spaced in rank. Per feature it becomes one array
    on a one-row side that is broadcast, and each row searches it in place.
    """
    arrays = table.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("rows"))
    lookup = arrays.agg(F.map_from_entries(F.collect_list(F.struct("feature", "rows.value"))).alias("_tables"))
    with_table = df.withColumn("_tables", lookup.scalar())

    # knots, value and place are columns of their own, so each search of a table runs once a row
    facts = with_table.select(
        *df.columns, *[f(c) for c in columns for f in (
            lambda c: F.try_element_at(F.col("_tables"), F.lit(c)).alias(f"_knots_{c}"), lambda c: F.col(c).cast("double").alias(f"_value_{c}")
        )]
    )
    # last knot at or below the value, 1-based
    found = facts.select("*", *[knots_upto(F.col(f"_knots_{c}"), F.col(f"_value_{c}")).alias(f"_at_{c}") for c in columns])

    def place(c):
        xs, x, i = F.col(f"_knots_{c}"), F.col(f"_value_{c}"), F.col(f"_at_{c}")
        step = 0.98 / F.greatest(F.size(xs) - 1, F.lit(1))
        left, right = F.get(xs, i - 1), F.get(xs, i)
        inside = 0.01 + step * (i - 1) + step * (x - left) / (right - left)
        return (
            F.when(xs.isNull() | x.isNull(), 0.5)
            .when(i == 0, 0.01)
            .when(i >= F.size(xs), 0.99)
            .otherwise(inside)
        )

    return found.select(*df.columns, *[place(c).alias(f"qrank_{c}") for c in columns])


SMALL_COMMIT = 64


def cochange_totals(changes):
    """Per file: commits, co-changes (other files over all its commits), and exact distinct peers.

    Pairs are never shuffled: a commit with n files would give n*n rows. Peers are
    kept as bitmaps over the repository's file numbers, 32,768 per bitmap, and the
    bits set for a file, less its own, count its peers. A commit of up to
    SMALL_COMMIT files hands each of them its short list of numbers; a larger one
    hands them its bitmaps, so its cost stays proportional to its files.
    """
    members = changes.select("repo", "commit_id", "file_path").distinct()
    per_commit = members.groupBy("repo", "commit_id").agg(F.count(F.lit(1)).alias("n_files"))
    coded = members.join(_file_numbers(members), FILE).join(per_commit, ["repo", "commit_id"])
    small, large = coded.where(F.col("n_files") <= SMALL_COMMIT), coded.where(F.col("n_files") > SMALL_COMMIT)

    lists = small.groupBy("repo", "commit_id").agg(F.collect_list(F.struct("file_path", "number")).alias("files"))
    from_small = (
        lists.select("repo", F.inline("files"), F.col("files.number").alias("numbers"))
        .select(*FILE, F.explode("numbers").alias("peer"))
        .groupBy(*FILE, F.expr("bitmap_bucket_number(peer)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(peer))").alias("bits"))
    )
    maps = large.groupBy("repo", "commit_id", F.expr("bitmap_bucket_number(number)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("bits")
    )
    from_large = (
        large.select("repo", "commit_id", "file_path")
        .join(maps, ["repo", "commit_id"])
        .groupBy(*FILE, "bucket")
        .agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    )
    peers = (
        from_small.unionByName(from_large)
        .groupBy(*FILE, "bucket")
        .agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        .groupBy(*FILE)
        .agg((F.sum(F.expr("bitmap_count(bits)")) - 1).alias("distinct_peers"))
    )
    sums = members.join(per_commit, ["repo", "commit_id"]).groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum(F.col("n_files") - 1).alias("co_changes"),
        F.count_if(F.col("n_files") > 1).alias("coupled_commits"),
    )
    return sums.join(peers, FILE)


def _file_numbers(members):
    """Number the files of each repository 1, 2, 3, ... in hash order."""
    named = members.select(*FILE).distinct().withColumn("_hash", F.md5("file_path")).withColumn("_one", F.lit(1).cast("long"))
    return running(
        named, ["repo"], [F.substring("_hash", 1, 3)], ["_hash", "file_path"], {"number": ("sum", "_one")}, inclusive=True
    ).select(*FILE, "number")


def cochange_features(snapshots):
    """Per file: peers, coupling ratio, mean complexity and size over its co-changed snapshots, cluster size, peer rank.

    Peer means weigh a peer by the commits it shares, from per-commit sums less the file's own.
    """
    totals = cochange_totals(snapshots)
    per_commit = snapshots.groupBy("repo", "commit_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("code_loc").alias("loc"), F.sum("code_max_cyclomatic_complexity").alias("cc")
    )
    means = snapshots.join(per_commit, ["repo", "commit_id"]).groupBy(*FILE).agg(
        F.coalesce(F.try_divide(F.sum(F.col("cc") - F.col("code_max_cyclomatic_complexity")), F.sum(F.col("n") - 1)), F.lit(0.0)).alias("cochange_peer_complexity_mean"),
        F.coalesce(F.try_divide(F.sum(F.col("loc") - F.col("code_loc")), F.sum(F.col("n") - 1)), F.lit(0.0)).alias("cochange_peer_loc_mean"),
    )
    sized = totals.groupBy("repo", "distinct_peers").agg(F.count(F.lit(1)).alias("_files"))
    below = running(sized, ["repo"], [F.floor(F.col("distinct_peers") / 1000)], ["distinct_peers"], {"_upto": ("sum", "_files")}, inclusive=True)
    files = totals.groupBy("repo").agg(F.count(F.lit(1)).alias("_all"))
    return (
        totals.join(means, FILE)
        .join(below.drop("_files"), ["repo", "distinct_peers"])
        .join(files, "repo")
        .select(
            *FILE,
            F.col("distinct_peers").alias("cochange_peer_count"),
            (F.col("coupled_commits") / F.col("commits")).alias("cochange_coupling_ratio"),
            "cochange_peer_complexity_mean",
            "cochange_peer_loc_mean",
            (F.col("_upto") / F.col("_all")).alias("rank_cochange_peer_count"),
            (F.col("distinct_peers") + 1).alias("cochange_cluster_size"),
        )
    )


def ownership_features(df):
    """Silo index, contributors per year and complexity-churn product from history columns."""
    return df.select(
        "*",
        F.coalesce(F.try_divide(F.col("ownership_concentration"), F.col("contributors")), F.lit(0.0)).alias("silo_index"),
        (F.col("contributors") * 365.0 / F.greatest(F.col("file_age_days"), F.lit(1.0))).alias("contributor_annual_rate"),
        (F.col("code_max_cyclomatic_complexity") * F.col("previous_file_commits")).alias("complexity_churn_interaction"),
    )


def feature_row(df, features, keep, quantiles=None):
    """The feature vector of an engine as columns: present columns as double, missing ones 0.

    rank_X comes from the quantile tables when given; rel_X falls back to X itself.
    """
    if quantiles is not None:
        wanted = [f[5:] for f in features if f.startswith("rank_") and f[5:] in df.columns]
        df = quantile_rank(df, wanted, quantiles)
    out = []
    for f in features:
        stem = f.split("_", 1)[1] if "_" in f else f
        if f.startswith("rank_") and f"qrank_{stem}" in df.columns:
            value = F.col(f"qrank_{stem}")
        elif f in df.columns:
            value = F.col(f)
        elif f.startswith("rank_"):
            value = F.lit(0.5)
        elif f.startswith("rel_") and stem in df.columns:
            value = F.col(stem)
        else:
            value = F.lit(0.0)
        out.append(F.coalesce(value.cast("double"), F.lit(0.0)).alias(f))
    return df.select(*keep, *out)


def feature_set_diff(spark_names, removed, forbidden=FORBIDDEN):
    """Rows (feature, status): kept, removed or forbidden, for a one-column table of names."""
    return spark_names.withColumn(
        "status",
        F.when(F.col("feature").isin(list(forbidden)), "forbidden")
        .when(F.col("feature").isin(list(removed)), "removed")
        .otherwise("kept"),
    )


def importance_rank(importance, n):
    """The n most important features with their rank 1, 2, ...; the input has one row per feature."""
    from pyspark.sql import Window

    top = importance.orderBy(F.desc("importance"), "feature").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
