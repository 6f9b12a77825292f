import pytest
from pyspark.sql import functions as F

from faultline.operators import commits as op
from faultline.operators import evaluation


def score(spark, message, **kw):
    df = spark.createDataFrame([(1, "r", message)], "commit_id long, repo string, message string")
    return op.score_commits(df, **kw).first()


@pytest.mark.parametrize(
    "message, fix",
    [
        ("Fix null pointer exception in login handler (#1234)", True),
        ("Update README with installation instructions", False),
        ("Refactor database connection logic for clarity", False),
        ("hotfix: patch for broken login endpoint", True),
        ("", False),
    ],
)
def test_examples(spark, message, fix):
    assert score(spark, message)["is_bug_fix"] is fix


def test_counts_are_capped_and_score_clipped(spark):
    row = score(spark, "fix fix bug crash regression resolve error deadlock closes #1 fixes #2")
    assert (row["k"], row["i"], row["s"]) == (3, 2, 3)
    assert row["score"] == 1.0


def test_noise_dominated(spark):
    row = score(spark, "Merge and format code")
    assert row["noise_dominated"] and not row["is_bug_fix"] and row["score"] == 0.0


def test_issue_keys_only_on_request(spark):
    assert score(spark, "KAFKA-12 handle shutdown")["i"] == 0
    assert score(spark, "KAFKA-12 handle shutdown", match_issue_keys=True)["i"] == 1


def test_word_boundaries_follow_unicode(spark):
    assert score(spark, "éfix")["s"] == 0
    assert score(spark, "prefix only")["k"] == 0


def test_threshold_is_tested_before_rounding(spark):
    assert score(spark, "hotfix patch")["is_bug_fix"] is True  # exactly 0.40
    assert score(spark, "hotfix patch", threshold=0.41)["is_bug_fix"] is False


def kappa(spark, a, b):
    df = spark.createDataFrame(list(zip(a, b)), "a boolean, b boolean")
    return evaluation.cohens_kappa(df, "a", "b").first()


def test_kappa(spark):
    assert kappa(spark, [True, True, False, False], [True, True, False, False])["kappa"] == 1.0
    assert kappa(spark, [True, False, True, False], [False, True, False, True])["kappa"] < 0
    assert kappa(spark, [True] * 3, [True] * 3)["kappa"] == 1.0


def test_sample_sizes(spark):
    df = spark.range(400).select(
        F.col("id").alias("commit_id"), F.lit("r").alias("repo"), F.when(F.col("id") % 2 == 0, "fix crash").otherwise("words").alias("message")
    )
    got = {r["stratum"]: r["count"] for r in op.stratified_sample(df, {"high_conf_positive": 7, "boundary": 5, "near_miss": 3, "high_conf_negative": 2}).groupBy("stratum").count().collect()}
    assert got == {"high_conf_positive": 7, "high_conf_negative": 2}
