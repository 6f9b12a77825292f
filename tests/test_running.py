import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators import features, history
from faultline.operators.running import day_level, exact_quantiles, month_level, ranked, running


def events(spark, n=3000, seed=1):
    """One key holds half of all rows."""
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(5)}", rnd.randrange(0, 200 * 86400), i, rnd.randrange(100)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, ts long, id long, v long")


def test_running_equals_plain_window(spark):
    df = events(spark)
    aggs = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")}
    for inclusive, last in ((False, -1), (True, 0)):
        w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, last)
        want = df.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"))
        for levels in ([month_level(F.col("ts"))], [month_level(F.col("ts")), day_level(F.col("ts"))]):
            got = running(df, ["key"], levels, ["ts", "id"], aggs, inclusive).select("id", "s", "hi", "lo")
            assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_rank_without_key(spark):
    df = events(spark, 500)
    got = {r["id"]: r["rank"] for r in ranked(df, [], [day_level(F.col("ts"))], ["ts", "id"]).collect()}
    want = sorted(df.collect(), key=lambda r: (r["ts"], r["id"]))
    assert got == {r["id"]: i for i, r in enumerate(want, 1)}


def test_quantiles_interpolate(spark):
    import numpy as np

    values = [5, 1, 4, 4, 9, 2, 2, 2, 30, 7]
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, x double")
    got = {round(r["prob"], 2): r["quantile"] for r in exact_quantiles(df, ["k"], "x", [0, 0.1, 0.5, 0.77, 1]).collect()}
    for p, q in got.items():
        assert abs(q - np.quantile(values, p)) < 1e-9


def test_causal_rank_brute_force(spark):
    rnd = random.Random(3)
    rows = [("r", f"f{i % 4}", i, 86400 * rnd.randrange(60), float(rnd.randrange(700))) for i in range(600)]
    df = spark.createDataFrame(rows, "repo string, file_path string, commit_id long, t long, x double").withColumn(
        "commit_date", F.timestamp_seconds("t")
    )
    got = {r["commit_id"]: r["rank_x"] for r in features.causal_rank(df, ["x"]).collect()}
    for _, _, i, t, x in rows:
        seen = [y for *_, u, y in rows if u <= t]
        assert abs(got[i] - sum(y <= x for y in seen) / len(seen)) < 1e-12


def test_cochange_counts_large_commits_exactly(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [("r", c, f"f{rnd.randrange(40)}") for c in range(12) for _ in range(rnd.choice([1, 3, 30]))]
    df = spark.createDataFrame(rows, "repo string, commit_id long, file_path string")
    peers = {}
    for _, c, f in rows:
        peers.setdefault(f, set()).update(g for _, d, g in rows if d == c and g != f)
    for small in (0, 5, 64):
        monkeypatch.setattr(features, "SMALL_COMMIT", small)
        got = {r["file_path"]: r["distinct_peers"] for r in features.cochange_totals(df).collect()}
        assert got == {f: len(p) for f, p in peers.items()}


def test_labels_look_strictly_ahead(spark):
    day = 86400
    rows = [(1, 0, True, 0.8), (2, 0, False, 0.1), (3, 90 * day, True, 0.6), (4, 181 * day, True, 0.9)]
    ch = spark.createDataFrame(rows, "commit_id long, t long, is_bug_fix boolean, score double").select(
        F.lit("r").alias("repo"), F.lit("f").alias("file_path"), "commit_id", F.timestamp_seconds("t").alias("commit_date"), "is_bug_fix", "score"
    )
    got = {r["commit_id"]: (r["label"], r["label_score"]) for r in history.future_label(ch, ch.select("repo", "file_path", "commit_id", "commit_date")).collect()}
    assert got == {1: (1, 0.6), 2: (1, 0.6), 3: (0, 0.0), 4: (0, 0.0)}


def test_stepwise_equals_plain_window(spark):
    """One key holds half of all rows; several rows share a position, null keys and orders count for nothing."""
    from faultline.operators.running import quarter_level, stepwise

    df = events(spark).withColumn("ts", F.floor(F.col("ts") / 40_000) * 40_000)
    odd = spark.createDataFrame([(None, 5, 1, 1), ("hot", None, 2, 2)], df.schema)
    aggs = {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "id")}
    per = df.groupBy("key", "ts").agg(F.sum("v").alias("s"), F.max("v").alias("hi"), F.min("id").alias("lo"))
    for inclusive, last in ((False, -1), (True, 0)):
        w = Window.partitionBy("key").orderBy("ts").rowsBetween(Window.unboundedPreceding, last)
        want = per.select("key", "ts", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("s"), F.max("hi").over(w).alias("hi"), F.min("lo").over(w).alias("lo"))
        for level in (day_level(F.col("ts")), quarter_level(F.col("ts"))):
            got = stepwise(df.unionByName(odd), ["key"], "ts", level, aggs, inclusive).select("key", "ts", "s", "hi", "lo")
            assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_knots_upto(spark):
    from faultline.operators.features import knots_upto

    rng = random.Random(2)
    rows = [(sorted(float(rng.randrange(9)) for _ in range(rng.randint(0, 12))), float(rng.randrange(-1, 10))) for _ in range(200)]
    got = spark.createDataFrame(rows, "k array<double>, x double").select("k", "x", knots_upto(F.col("k"), F.col("x")).alias("n")).collect()
    assert all(r.n == sum(v <= r.x for v in r.k) for r in got)


def test_causal_rank_works_its_input_out_twice_at_most(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("r", "f", i, 86400 * (i % 7), float(i % 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "repo string, file_path string, commit_id long, t long, x double").mapInArrow(
        counted, "repo string, file_path string, commit_id long, t long, x double"
    ).withColumn("commit_date", F.timestamp_seconds("t"))
    assert len(features.causal_rank(df, ["x"]).collect()) == 200
    assert read.value <= 400
