"""Scored commits, annotation strata and samples."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.functions.text import DEFAULT_THRESHOLD, clean_text, raw_score, rule_annotation, score_counts, stratum, strip


def score_commits(commits, threshold=DEFAULT_THRESHOLD, match_issue_keys=False):
    """Add score, k, i, s, n, is_bug_fix, noise_dominated."""
    cleaned = commits.withColumn("_text", clean_text(F.col("message")))
    k, i, s, n = score_counts(F.col("_text"), F.col("message"), match_issue_keys)
    counted = cleaned.select(*commits.columns, k.alias("k"), i.alias("i"), s.alias("s"), n.alias("n"))
    weighed = counted.withColumn("_raw", raw_score(F.col("k"), F.col("i"), F.col("s"), F.col("n")))
    noisy = (F.col("n") >= 2) & (F.col("s") == 0)
    return weighed.select(
        *counted.columns,
        F.round("_raw", 4).alias("score"),
        ((F.col("_raw") >= F.lit(float(threshold))) & ~noisy).alias("is_bug_fix"),
        noisy.alias("noise_dominated"),
    )


def threshold_sweep(commits, thresholds):
    """Commits and bug-fix share per threshold, which the score must reach unrounded, as in score_commits.

    Commits are first counted per combination of hits, so the thresholds multiply a handful of rows and not the commits.
    """
    hits = ["k", "i", "s", "n"]
    scored = score_commits(commits).groupBy(*hits, "noise_dominated").agg(F.count(F.lit(1)).alias("commits"))
    scored = scored.withColumn("_raw", raw_score(*[F.col(c) for c in hits]))
    grid = scored.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    positive = F.sum(
        F.when((F.col("_raw") >= F.col("threshold")) & ~F.col("noise_dominated"), F.col("commits")).otherwise(0)
    )
    return grid.groupBy("threshold").agg(
        F.sum("commits").alias("commits"),
        positive.alias("positives"),
        (positive / F.sum("commits")).alias("positive_rate"),
    )


def annotate(commits):
    """Add label, confidence and note of the ordered annotation rules."""
    return commits.withColumn("_rule", rule_annotation(F.col("message"))).select("*", "_rule.*").drop("_rule")


def with_stratum(commits):
    return score_commits(commits).withColumn("stratum", stratum(F.col("score"), F.col("k")))


def stratified_sample(commits, targets, seed=42):
    """At most targets[stratum] commits per stratum, without replacement, in seeded hash order."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("repo"), F.col("commit_id").cast("string")))
    stratified = with_stratum(commits).withColumn("_order", order)
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("stratum"))
    numbered = stratified.withColumn(
        "_n", F.row_number().over(Window.partitionBy("stratum").orderBy("_order", "commit_id"))
    )
    # the constant bound lets Spark cut every stratum to its head before the shuffle
    return numbered.where((F.col("_n") <= max(targets.values())) & (F.col("_n") <= limit)).drop("_n", "_order")


def first_n_commits(commits, n=120, min_length=5):
    """The first n commits of each repository, of these the ones whose message is longer than min_length."""
    numbered = commits.withColumn(
        "_n", F.row_number().over(Window.partitionBy("repo").orderBy("commit_date", "commit_id"))
    )
    return numbered.where((F.col("_n") <= n) & (F.length(strip(F.col("message"))) > min_length)).drop("_n")


def strata_distribution(commits):
    return with_stratum(commits).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("is_bug_fix").cast("long")).alias("positives"),
        (F.avg(F.col("is_bug_fix").cast("double")) * 100).alias("positive_rate_pct"),
    )
