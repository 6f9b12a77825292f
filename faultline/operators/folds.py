"""Time and project splits as fold tables, and their integrity checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators.running import day_level, month_level, ranked

MIN_TRAIN, MIN_TEST = 50, 10


def _stamped(df):
    return df.withColumn("ts", F.unix_timestamp("commit_date"))


def fold_intervals(df, n_folds=10, file="canonical_file_id"):
    """`df` with ts, train_from and test_fold: an expanding window over equal spans of time, one row for each row.

    Fold i trains up to boundary i+1 and tests on what follows up to boundary i+2, on files first seen after the
    training period. So a row trains in every fold from `train_from` to the last one, and tests in `test_fold` at most; null says
    in none. A file is new for a fold exactly when its first date lies beyond the boundary, so one minimum per file
    replaces an anti join per fold. Folds without train or test rows are left out and the others numbered from 0.
    """
    stamped = _stamped(df)
    span = stamped.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi"))).scalar()
    first_seen = stamped.groupBy(file).agg(F.min("ts").alias("_first"))
    rows = stamped.join(first_seen, file).withColumn("_span", span)
    lo, width = F.col("_span.lo"), F.col("_span.hi") - F.col("_span.lo")
    cuts = F.array(*[lo + width * (i + 1) / F.lit(float(n_folds)) for i in range(n_folds - 1)])
    rows = rows.withColumn("_cuts", cuts).withColumn("_from", F.size(F.filter("_cuts", lambda c: c < F.col("ts"))))
    last = n_folds - 2
    end = lo + width * (n_folds) / F.lit(float(n_folds))
    tests = (F.col("_from") > 0) & (F.col("_first") > F.get("_cuts", F.col("_from") - 1)) & ((F.col("_from") <= last) | (F.col("ts") <= end))
    rows = rows.withColumn("_test", F.when(tests, F.col("_from") - 1))
    # at most n_folds rows: numbering the folds in use needs no large sort
    counts = rows.groupBy("_from", "_test").agg(F.count(F.lit(1)).alias("n"))
    used = counts.agg(
        F.array_sort(F.array_distinct(F.collect_list("_test"))).alias("tested"), F.min("_from").alias("trained")
    ).select(F.filter("tested", lambda i: i >= F.col("trained"))).scalar()
    rows = rows.withColumn("_used", used)
    since = F.size(F.filter("_used", lambda i: i < F.col("_from")))
    place = F.array_position("_used", F.col("_test"))
    return rows.select(
        *df.columns, "ts", F.when(since < F.size("_used"), since).alias("train_from"), F.when(place > 0, (place - 1).cast("int")).alias("test_fold"), F.size("_used").alias("n_folds")
    )


def temporal_folds(df, keep, n_folds=10, file="canonical_file_id"):
    """Rows (fold, role, *keep): the intervals written out, a row for each fold that a row trains or tests in."""
    rows = fold_intervals(df, n_folds, file)
    trained = F.when(F.col("train_from").isNotNull(), F.sequence("train_from", F.col("n_folds") - 1))
    train = F.transform(trained, lambda i: F.struct(i.alias("fold"), F.lit("train").alias("role")))
    test = F.when(F.col("test_fold").isNotNull(), F.array(F.struct(F.col("test_fold").alias("fold"), F.lit("test").alias("role"))))
    empty = F.array().cast("array<struct<fold:int,role:string>>")
    return rows.select(F.explode(F.concat(F.coalesce(train, empty), F.coalesce(test, empty))).alias("_r"), *keep).select("_r.fold", "_r.role", *keep)


def interval_stats(rows, file="canonical_file_id", label="future_bug_fix"):
    """Rows, files, positives and dates of both sides of each fold, from fold_intervals without writing the folds out.

    What enters training at a fold stays in all later ones: counts per first fold, added up over the folds. A file trains from
    its first row on.
    """
    def side(at, role):
        own = rows.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("fold")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("positives"), F.min("ts").alias("first"), F.max("ts").alias("last")
        )
        return own.withColumn("role", F.lit(role))

    files = rows.where("train_from IS NOT NULL").groupBy(file).agg(F.min("train_from").alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("files"))
    folds = rows.agg(F.max("n_folds").alias("n")).where("n > 0").select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("fold"))
    upto = Window.orderBy("fold")  # a row for each fold
    train = folds.join(side("train_from", "train").drop("role"), "fold", "left").join(files, "fold", "left").select(
        "fold", F.lit("train").alias("role"),
        *[F.sum(c).over(upto).alias(c) for c in ("rows", "files", "positives")], F.min("first").over(upto).alias("first"), F.max("last").over(upto).alias("last"),
    )
    tested = rows.where("test_fold IS NOT NULL").groupBy(F.col("test_fold").alias("fold")).agg(F.countDistinct(file).alias("files"))
    test = side("test_fold", "test").join(tested, "fold").select(*train.columns)
    return train.unionByName(test)


def interval_checks(rows, file="canonical_file_id", min_train=MIN_TRAIN, min_test=MIN_TEST):
    """Per fold of fold_intervals: sizes, latest training and earliest test time, files on both sides, and `violated` where these
    are too small, touch or cross, or there are any."""
    stats = interval_stats(rows.withColumn("_none", F.lit(0)), file, "_none")
    sides = stats.groupBy("fold").agg(
        F.max(_side("train", F.col("rows"))).alias("train_rows"), F.max(_side("test", F.col("rows"))).alias("test_rows"),
        F.max(_side("train", F.col("last"))).alias("max_train"), F.min(_side("test", F.col("first"))).alias("min_test"),
    )
    since = rows.groupBy(file).agg(F.min("train_from").alias("since"), F.collect_set("test_fold").alias("tested"))  # n_folds at most
    shared = since.select(F.explode(F.filter("tested", lambda i: i >= F.col("since"))).alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("shared_files"))
    checked = sides.join(shared, "fold", "left").withColumn("shared_files", F.coalesce("shared_files", F.lit(0)))
    small = (F.col("train_rows") < min_train) | (F.coalesce("test_rows", F.lit(0)) < min_test)
    return checked.withColumn("violated", small | (F.col("shared_files") > 0) | F.coalesce(F.col("max_train") >= F.col("min_test"), F.lit(False)))


def lopo_folds(df, label="future_bug_fix"):
    """One row per repository held out: sizes and positives of both sides.

    A row's role follows from its repository alone, so the training side is kept
    as totals less the held-out part instead of repeating every row per repository.
    """
    per_repo = df.groupBy("repo").agg(F.count(F.lit(1)).alias("test_rows"), F.sum(label).cast("long").alias("test_positives"))
    totals = per_repo.agg(F.struct(F.sum("test_rows").alias("n"), F.sum("test_positives").alias("p"))).scalar()
    return per_repo.withColumn("_t", totals).select(
        F.col("repo").alias("held_out"),
        (F.col("_t.n") - F.col("test_rows")).alias("train_rows"),
        "test_rows",
        (F.col("_t.p") - F.col("test_positives")).alias("train_positives"),
        "test_positives",
    ).where("train_rows > 0")


def time_split(df, key, train=0.70, calibrate=0.85):
    """role by position in time: the first 70 % train, up to 85 % calibrate, the rest test."""
    stamped = _stamped(df)
    placed = ranked(stamped, [], [month_level(F.col("ts")), day_level(F.col("ts"))], ["ts", *key], "_pos")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    role = (
        F.when(F.col("_pos") <= F.floor(F.lit(train) * n), "train")
        .when(F.col("_pos") <= F.floor(F.lit(calibrate) * n), "calibrate")
        .otherwise("test")
    )
    return placed.withColumn("role", role).select(*df.columns, "role")


def ood_split(df, reserved):
    return df.withColumn("role", F.when(F.col("repo").isin(list(reserved)), "ood_test").otherwise("train"))


def exclude_known_files(test, train, file="canonical_file_id"):
    return test.join(train.select(file).distinct(), file, "left_anti")


def file_overlap(train, test, file="canonical_file_id", samples=5):
    """One row: number of files on both sides and the first few of them."""
    shared = train.select(file).intersect(test.select(file))
    first = shared.orderBy(file).limit(samples)
    return shared.agg(F.count(F.lit(1)).alias("n_overlap")).withColumn(
        "samples", first.agg(F.array_join(F.array_sort(F.collect_list(file)), ",")).scalar()
    )


# Fold tables below have fold, role ('train' / 'test') and the columns a check names.

def _side(role, value):
    return F.when(F.col("role") == role, value)


def check_temporal(folds):
    """Per fold: latest training and earliest test time; violated when they touch or cross."""
    return folds.groupBy("fold").agg(
        F.max(_side("train", F.col("ts"))).alias("max_train"), F.min(_side("test", F.col("ts"))).alias("min_test")
    ).withColumn("violated", F.coalesce(F.col("max_train") >= F.col("min_test"), F.lit(False)))


def check_identity(folds, file="canonical_file_id"):
    """Per fold: files on both sides; violated when there are any."""
    per_file = folds.groupBy("fold", file).agg(
        F.bool_or(F.col("role") == "train").alias("_a"), F.bool_or(F.col("role") == "test").alias("_b")
    )
    return per_file.groupBy("fold").agg(F.count_if(F.col("_a") & F.col("_b")).alias("shared_files")).withColumn(
        "violated", F.col("shared_files") > 0
    )


def check_lopo(folds):
    """Per held-out repository: its rows in train and foreign rows in test; violated when there are any."""
    return folds.groupBy("fold").agg(
        F.count_if((F.col("role") == "train") & (F.col("repo") == F.col("fold"))).alias("held_out_in_train"),
        F.count_if((F.col("role") == "test") & (F.col("repo") != F.col("fold"))).alias("foreign_in_test"),
    ).withColumn("violated", (F.col("held_out_in_train") > 0) | (F.col("foreign_in_test") > 0))


def check_sizes(folds, min_train=MIN_TRAIN, min_test=MIN_TEST):
    return folds.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("train_rows"), F.count_if(F.col("role") == "test").alias("test_rows")
    ).withColumn("violated", (F.col("train_rows") < min_train) | (F.col("test_rows") < min_test))


def require_clean(checked, what):
    """Raise when a check table has a violated fold; reads at most five rows."""
    bad = checked.where("violated").limit(5).collect()
    if bad:
        raise ValueError(f"{what}: violated in folds {[r['fold'] for r in bad]}: {bad[0].asDict()}")


def fold_stats(folds, file="canonical_file_id", label="future_bug_fix"):
    return folds.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(file).alias("files"),
        F.sum(label).cast("long").alias("positives"),
        F.date_format(F.timestamp_seconds(F.min("ts")), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.timestamp_seconds(F.max("ts")), "yyyy-MM-dd").alias("last_date"),
    )
