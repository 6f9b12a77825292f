"""Evaluation statistics from score points: one row per distinct score with its counts."""

import hashlib
import statistics

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from faultline.operators.running import hash_level, ranked, running, value_level
from faultline.session import materialize


def score_points(df, keys, y="y", p="p"):
    """Counts per distinct score: rows (keys, p, pos, n). Everything below starts here, so ties are exact."""
    return df.groupBy(*keys, F.col(p).cast("double").alias("p")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )


def ranked_points(points, keys, level=None):
    """Points with the positives and rows scored strictly higher, and the totals of the group. `level`, a column of points that does not
    decrease as p falls, cuts them where scores crowd."""
    down = points.withColumn("_down", -F.col("p"))
    placed = running(
        down, keys, [value_level(F.col("_down")) if level is None else level], ["_down"], {"tp_before": ("sum", "pos"), "n_before": ("sum", "n")}
    ).drop("_down")
    sums = [F.sum("pos").alias("positives"), F.sum("n").alias("total")]
    if keys:
        return placed.join(points.groupBy(*keys).agg(*sums), keys)
    totals = points.agg(F.struct(*sums)).scalar()
    return placed.withColumn("_t", totals).select(*placed.columns, "_t.positives", "_t.total")


def _precision_area():
    pos, n = F.col("pos"), F.col("n")
    return F.sum(
        F.coalesce(F.try_divide(pos, F.col("positives")), F.lit(0.0)) * (F.col("tp_before") + pos) / (F.col("n_before") + n)
    )


def _pair_share():
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    return F.try_divide(
        F.sum(neg * (F.col("tp_before") + pos / 2.0)), F.max(F.col("positives") * (F.col("total") - F.col("positives")))
    )


def average_precision(df, keys, y="y", p="p"):
    return precision_areas(ranked_points(score_points(df, keys, y, p), keys), keys)


def precision_areas(placed, keys):
    """The average precision of ranked points."""
    return placed.groupBy(*keys).agg(_precision_area().alias("pr_auc"))


def roc_auc(df, keys, y="y", p="p", one_class=0.0):
    """Share of (positive, negative) pairs ranked rightly, ties half; `one_class` where a class is missing."""
    return ranked_points(score_points(df, keys, y, p), keys).groupBy(*keys).agg(
        F.coalesce(_pair_share(), F.lit(float(one_class))).alias("roc_auc")
    )


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def threshold_aggregates(y, p, threshold):
    """Aggregates tp, fp, fn, tn at a threshold."""
    hit = F.col(p) >= threshold
    real = F.col(y) == 1
    return [
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"),
    ]


def threshold_metrics(df, keys, y="y", p="p", threshold=0.5):
    """Precision, recall and F1 at a threshold, 0 on empty denominators."""
    counts = df.groupBy(*keys).agg(*threshold_aggregates(y, p, threshold))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *keys, "tp", "fp", "fn", "tn",
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _squared_error(y, p):
    d = F.col(p) - F.col(y)
    return F.avg(d * d)


def brier(df, keys, y="y", p="p"):
    return df.groupBy(*keys).agg(_squared_error(y, p).alias("brier"))


def calibration_bins(df, keys, y="y", p="p", bins=10):
    """Per equal-width bin: rows, mean score, observed rate."""
    bin_no = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(p).alias("mean_predicted"), F.avg(y).alias("observed_rate")
    )


def expected_calibration_error(df, keys, y="y", p="p", bins=10):
    gap = F.abs(F.col("observed_rate") - F.col("mean_predicted")) * F.col("rows")
    return calibration_bins(df, keys, y, p, bins).groupBy(*keys).agg((F.sum(gap) / F.sum("rows")).alias("ece"))


def fold_metrics(df, keys, y="y", p="p", threshold=0.5):
    """pr_auc, roc_auc, f1, precision, recall, brier_score, support, n_test, positive_rate per key, from score points."""
    points = ranked_points(score_points(df, keys, y, p), keys)
    high = F.col("p") >= threshold
    neg = F.col("n") - F.col("pos")
    square = F.col("pos") * (F.col("p") - 1.0) * (F.col("p") - 1.0) + neg * F.col("p") * F.col("p")
    sums = points.groupBy(*keys).agg(
        _precision_area().alias("pr_auc"),
        F.coalesce(_pair_share(), F.lit(0.0)).alias("roc_auc"),
        F.sum(F.when(high, F.col("pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(high, neg).otherwise(0)).alias("_fp"),
        (F.sum(square) / F.max("total")).alias("brier_score"),
        F.max("positives").alias("support"),
        F.max("total").alias("n_test"),
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("support") - F.col("_tp")
    return sums.select(
        *keys, "pr_auc", "roc_auc", _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), "brier_score", "support", "n_test", (F.col("support") / F.col("n_test")).alias("positive_rate"),
    )


def repo_evaluation(df, y="y", p="p", share=0.20, pooled_name="(pooled)"):
    """Per repository and pooled: size, prevalence, PR-AUC, ROC-AUC, Brier, lift, precision and recall in the top share.

    Rows tied at the cut of the top share enter it in proportion. One class only
    gives prevalence, 0.5, lift 0 and a recall equal to the share.
    """
    per_repo = score_points(df, ["repo"], y, p)
    pooled = per_repo.groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).withColumn("repo", F.lit(pooled_name))
    points = ranked_points(per_repo.unionByName(pooled), ["repo"])
    neg = F.col("n") - F.col("pos")
    square = F.col("pos") * (F.col("p") - 1.0) * (F.col("p") - 1.0) + neg * F.col("p") * F.col("p")
    top = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(share)))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (top - F.col("n_before")) / F.col("n")))
    sums = points.groupBy("repo").agg(
        F.max("total").alias("n_rows"), F.max("positives").alias("n_pos"), F.max(top).alias("_k"),
        _precision_area().alias("_ap"), _pair_share().alias("_roc"),
        (F.sum(square) / F.max("total")).alias("brier"), F.sum(F.col("pos") * inside).alias("_caught"),
    )
    rate = F.col("n_pos") / F.col("n_rows")
    single = (F.col("n_pos") == 0) | (F.col("n_pos") == F.col("n_rows"))
    return sums.select(
        "repo", "n_rows", "n_pos", (F.col("n_rows") - F.col("n_pos")).alias("n_neg"), (rate * 100).alias("prevalence"),
        F.when(single, rate).otherwise(F.col("_ap")).alias("pr_auc"),
        F.when(single, 0.5).otherwise(F.col("_roc")).alias("roc_auc"),
        "brier",
        F.when(single, 0.0).otherwise(F.col("_ap") - rate).alias("lift"),
        (F.when(single, rate).otherwise(F.col("_caught") / F.col("_k")) * 100).alias("prec_at_20"),
        (F.when(single, share).otherwise(F.try_divide(F.col("_caught"), F.col("n_pos"))) * 100).alias("rec_at_20"),
    )


def top_share(df, key, score, share=0.20):
    """Rows of the top share by score (at least one row), ties in hash order."""
    hashed = df.withColumn("_down", -F.col(score)).withColumn(
        "_hash", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    )
    placed = ranked(hashed, [], [value_level(F.col("_down")), F.col("_down"), hash_level(F.col("_hash"), 2)], ["_hash", *key], "_pos")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return placed.where(F.col("_pos") <= F.greatest(F.lit(1), F.floor(n * F.lit(share)))).select(*df.columns)


def hybrid_scores(df, key, full="p_full", static="p_static", seed=42):
    """Half of the rows scored by each engine, chosen by a seeded hash."""
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), 1, 4), 16, 10).cast("int") % 2 == 1
    return df.withColumn("engine", F.when(pick, "full").otherwise("static")).withColumn(
        "p", F.when(pick, F.col(full)).otherwise(F.col(static))
    )


def release_gates(full_pooled, static_repos, static_pooled, full_scores, p="p_full"):
    """Five gates as rows (gate, value, passed).

    full_pooled / static_pooled: one-row pooled evaluations on reserved repositories;
    static_repos: per-repository evaluation of the others; full_scores: the full engine's scores.
    """
    tails = full_scores.agg(F.struct(F.min(p).alias("lo"), F.max(p).alias("hi"))).scalar()
    lopo = static_repos.agg(F.struct(F.avg("roc_auc").alias("roc"), F.avg("lift").alias("lift"))).scalar()
    one = full_pooled.select(
        F.col("brier").alias("b"), tails.alias("t"), lopo.alias("l"), static_pooled.select("roc_auc").scalar().alias("r")
    )

    def gate(name, value, passed):
        return F.struct(F.lit(name).alias("gate"), value.alias("value"), passed.alias("passed"))

    b, t, l, r = F.col("b"), F.col("t"), F.col("l"), F.col("r")
    return one.select(
        F.inline(
            F.array(
                gate("ood_brier", b, b <= 0.25),
                gate("probability_tails", t["hi"] - t["lo"], (t["lo"] > 0.001) & (t["hi"] < 0.999)),
                gate("lopo_roc_auc", l["roc"], l["roc"] >= 0.65),
                gate("lopo_lift", l["lift"], l["lift"] >= 0.08),
                gate("ood_roc_auc", r, r >= 0.65),
            )
        )
    )


# -- tables over fold results: model, feature_group, regime, key, pr_auc, ... ------------

def results_table(results):
    return results.groupBy("regime", "model", "feature_group").agg(
        F.avg("pr_auc").alias("mean_pr_auc"), F.stddev_samp("pr_auc").alias("std_pr_auc"), F.avg("roc_auc").alias("mean_roc_auc"),
        F.avg("f1").alias("mean_f1"), F.avg("brier_score").alias("mean_brier"), F.count("pr_auc").alias("folds"),
    )


def fold_ci(results, low=0.025, high=0.975):
    """Mean, population deviation and percentile bounds of fold scores where there is more than one fold."""
    return results.groupBy("regime", "model", "feature_group").agg(
        F.avg("pr_auc").alias("mean_pr_auc"), F.stddev_pop("pr_auc").alias("std_pr_auc"),
        F.percentile("pr_auc", F.lit(low)).alias("ci_lower"), F.percentile("pr_auc", F.lit(high)).alias("ci_upper"),
        F.count("pr_auc").alias("n_evaluations"),
    ).where("n_evaluations > 1")


def best_config(results):
    means = results.groupBy("model", "feature_group").agg(F.avg("pr_auc").alias("mean_pr_auc"))
    return means.agg(F.max(F.struct("mean_pr_auc", "model", "feature_group")).alias("b")).select("b.model", "b.feature_group", "b.mean_pr_auc")


def paired_scores(a, b, on, column="pr_auc", suffixes=("_a", "_b")):
    left = a.select(*on, F.col(column).alias(column + suffixes[0]))
    return left.join(b.select(*on, F.col(column).alias(column + suffixes[1])), on)


COMPARISONS = [("D", "C"), ("C", "A"), ("C", "B")]


def effect_sizes(pairs, keys, a="score_a", b="score_b"):
    """Mean difference, Cohen's d on population deviations and its magnitude per key."""
    pooled = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
    d = F.coalesce(F.try_divide(F.avg(a) - F.avg(b), pooled), F.lit(0.0))
    table = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), (F.avg(a) - F.avg(b)).alias("observed_diff"), d.alias("cohens_d")
    )
    size = F.abs(F.col("cohens_d"))
    return table.withColumn(
        "effect_magnitude", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    )


def group_pairs(results, comparisons=COMPARISONS):
    """Paired fold scores of the compared feature groups: (regime, model, comparison, key, score_a, score_b)."""
    out = None
    for x, y in comparisons:
        a = results.where(F.col("feature_group") == x).select("regime", "model", "key", F.col("pr_auc").alias("score_a"))
        b = results.where(F.col("feature_group") == y).select("regime", "model", "key", F.col("pr_auc").alias("score_b"))
        pairs = a.join(b, ["regime", "model", "key"]).withColumn("comparison", F.lit(f"{x} vs {y}"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def significance_grid(results, comparisons=COMPARISONS):
    """Effect sizes of the group comparisons where at least three folds pair up."""
    return effect_sizes(group_pairs(results, comparisons), ["regime", "model", "comparison"]).where("n_pairs >= 3")


def sign_flip_test(pairs, keys, pair_id, replicates=2000, alternative="two-sided", seed=42):
    """Paired test by flipping signs of the differences at random: p value and effect size per key.

    A pair's sign in a replicate is the first hex digit of md5("seed|replicate|pair"), minus below 8, so a rerun and any other
    engine give the same p value. The replicates' sums are combined before they move.
    """
    diffs = pairs.select(*keys, pair_id, (F.col("score_a") - F.col("score_b")).alias("_d"))
    flipped = diffs.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_rep"))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_rep").cast("string"), F.col(pair_id).cast("string")))
    sign = F.when(F.substring(draw, 1, 1) < "8", -1.0).otherwise(1.0)
    null = flipped.groupBy(*keys, "_rep").agg(F.avg(sign * F.col("_d")).alias("_m"))
    effects = effect_sizes(pairs, keys)
    # the observed mean is subject to rounding like the replicates, so equality is tested with a tiny slack
    m, seen = F.col("_m"), F.col("observed_diff")
    extreme = {
        "two-sided": F.abs(m) >= F.abs(seen) - 1e-12,
        "greater": m >= seen - 1e-12,
        "less": m <= seen + 1e-12,
    }[alternative]
    p_values = null.join(effects.select(*keys, "observed_diff"), keys).groupBy(*keys).agg(F.avg(extreme.cast("double")).alias("p_value"))
    return effects.join(p_values, keys).withColumn("significant_at_0_05", F.col("p_value") < 0.05).withColumn(
        "alternative", F.lit(alternative)
    )


#: Score points, or rows of replicate sums, that a task holds together.
TOGETHER = 256


def _poisson(mean, uniform):
    """The Poisson numbers of a mean at which its distribution reaches the uniform ones."""
    if not mean:
        return np.zeros(len(uniform), np.int64)
    k = np.arange(int(mean + 12 * mean**0.5) + 31)
    logs = np.cumsum(np.log(np.maximum(k, 1)))
    reached = np.cumsum(np.exp(-mean + k * np.log(mean) - logs))
    return np.minimum(np.searchsorted(reached, uniform, side="right"), len(k) - 1)


def _uniform(seed, kind, position, replicates):
    """Draws of a score point: the first 13 hex digits of md5("seed|replicate|kind|position") as a fraction."""
    heads = [hashlib.md5(f"{seed}|{r}|{kind}|{position}".encode()).hexdigest()[:13] for r in range(1, replicates + 1)]
    return np.array([int(h, 16) for h in heads], np.float64) / 2.0**52


def _resampled(points, replicates, seed):
    """(positives, rows) of each point, in descending order of scores, in each replicate."""
    order = np.argsort(points["position"].to_numpy())
    position, pos, n = (points[c].to_numpy()[order].tolist() for c in ("position", "pos", "n"))
    drawn = [[_poisson(m, _uniform(seed, kind, at, replicates)) for at, m in zip(position, means)] for kind, means in (("pos", pos), ("neg", [x - y for x, y in zip(n, pos)]))]
    positives = np.array(drawn[0], np.int64).reshape(len(pos), replicates)
    return positives, positives + np.array(drawn[1], np.int64).reshape(len(pos), replicates)


VECTORS = "bucket long, a binary, b binary"


def _vectors(table, name):
    return np.array([np.frombuffer(v) for v in table[name].to_pylist()])


def _row(bucket, a, b):
    return pa.table({"bucket": pa.array([bucket], pa.int64()), "a": pa.array([a.astype(np.float64).tobytes()], pa.binary()), "b": pa.array([b.astype(np.float64).tobytes()], pa.binary())})


def _upper(rows):
    return rows.withColumn("upper", F.floor(F.col("bucket") / TOGETHER).cast("long"))


def _added(rows):
    """The vectors of all rows (bucket, a, b) added up, TOGETHER rows at a time; one row."""

    def add(key, table):
        return _row(key[0].as_py(), _vectors(table, "a").sum(axis=0), _vectors(table, "b").sum(axis=0))

    top = rows.agg(F.max("bucket")).first()[0] or 0
    while True:
        rows = _upper(rows).groupBy("upper").applyInArrow(add, VECTORS)
        if top < TOGETHER:
            return rows
        top //= TOGETHER


def _earlier(rows):
    """For each bucket of `rows` (bucket, a, b) the sums over all buckets before it, TOGETHER buckets at a time; `rows` is read
    twice for each power of TOGETHER that the buckets reach."""

    def add(key, table):
        return _row(key[0].as_py(), _vectors(table, "a").sum(axis=0), _vectors(table, "b").sum(axis=0))

    def before(table, offset_a, offset_b):
        order = np.argsort(table["bucket"].to_numpy())
        out = []
        for name, offset in (("a", offset_a), ("b", offset_b)):
            own = _vectors(table, name)[order]
            out.append(np.cumsum(own, axis=0) - own + offset)
        return pa.concat_tables([_row(b, x, y) for b, x, y in zip(table["bucket"].to_numpy()[order].tolist(), *out)])

    if (rows.agg(F.max("bucket")).first()[0] or 0) < TOGETHER:
        return _upper(rows).groupBy("upper").applyInArrow(lambda table: before(table, 0.0, 0.0), VECTORS)
    offsets = _earlier(_upper(rows).groupBy("upper").applyInArrow(add, VECTORS)).withColumnRenamed("bucket", "upper")
    grouped = _upper(rows).groupBy("upper").cogroup(offsets.groupBy("upper"))
    return grouped.applyInArrow(lambda table, offset: before(table, _vectors(offset, "a")[0], _vectors(offset, "b")[0]), VECTORS)


def replicate_scores(points, replicates, seed):
    """The average precision of each replicate, NaN where it lacks a class.

    A task draws a bucket of score points for all replicates and sends their sums as one array; sums of the buckets before
    come back to it as one array, so replicates multiply buckets of TOGETHER points, neither rows nor scores.
    """
    down = points.withColumn("_down", -F.col("p"))
    placed = ranked(down, [], [value_level(F.col("_down"))], ["_down"], "position").select("position", "pos", "n")
    placed = materialize(placed.withColumn("bucket", F.floor((F.col("position") - 1) / TOGETHER).cast("long")), "points")

    def sums(key, table):
        positives, rows = _resampled(table, replicates, seed)
        return _row(key[0].as_py(), positives.sum(axis=0), rows.sum(axis=0))

    def areas(key, table, offset):
        positives, rows = _resampled(table, replicates, seed)
        tp = np.cumsum(positives, axis=0) + _vectors(offset, "a")
        n = np.cumsum(rows, axis=0) + _vectors(offset, "b")
        return _row(key[0].as_py(), (positives * tp / np.maximum(n, 1)).sum(axis=0), np.zeros(replicates))

    buckets = materialize(placed.groupBy("bucket").applyInArrow(sums, VECTORS), "bucket-sums")
    parts = placed.groupBy("bucket").cogroup(_earlier(buckets).groupBy("bucket")).applyInArrow(areas, VECTORS)
    total, area = _added(buckets).first(), _added(parts).first()
    if total is None:
        return np.full(replicates, np.nan)
    positives, rows = np.frombuffer(total["a"]), np.frombuffer(total["b"])
    usable = (positives > 0) & (positives < rows)
    return np.where(usable, np.frombuffer(area["a"]) / np.maximum(positives, 1), np.nan)


BOOTSTRAP = "point_estimate double, lower double, upper double, std_error double, n_bootstrap long, method string"


def bootstrap_ci(df, y="y", p="p", replicates=2000, confidence=0.95, method="bca", seed=42):
    """Bootstrap interval of the average precision, one row.

    Resampling counts are Poisson per row; rows with equal score and label have
    equal effect, so one Poisson draw with their count as mean replaces them. Replicates without both classes
    are dropped. The acceleration of `bca` leaves out each row in turn; below 100 replicates the interval is the percentile one.
    """
    points = score_points(df, [], y, p)
    scores = replicate_scores(points, replicates, seed)
    scores = scores[~np.isnan(scores)]
    point = ranked_points(points, []).agg(_precision_area().alias("ap")).first()["ap"]
    if not len(scores):
        return df.sparkSession.createDataFrame([(point, None, None, None, 0, "percentile")], BOOTSTRAP)
    tail = (1 - confidence) / 2
    used, probs = "percentile", [tail, 1 - tail]
    if method == "bca" and len(scores) >= 100:
        used = "bca"
        normal = statistics.NormalDist()
        below = min(max(float((scores < point).mean()), 1e-9), 1 - 1e-9)
        z0, a = normal.inv_cdf(below), _acceleration(points)
        probs = []
        for z in (normal.inv_cdf(tail), normal.inv_cdf(1 - tail)):
            probs.append(normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))))
    lower, upper = np.quantile(scores, probs)
    return df.sparkSession.createDataFrame([(float(point), float(lower), float(upper), float(scores.std()), len(scores), used)], BOOTSTRAP)


def left_out(points):
    """What leaving out one row changes in the average precision: rows (w, change), one for the negatives and one for the
    positives of each distinct score, `w` of them. From running sums of each point's own loss, so small changes stay exact."""
    pos, tp, n = F.col("pos"), F.col("tp_before") + F.col("pos"), F.col("n_before") + F.col("n")
    share = lambda x: F.when(n > 1, x / (n * (n - 1.0))).otherwise(0.0)
    terms = {"_area": pos * tp / n, "_gain": share(pos * tp), "_loss": share(pos * (n - tp))}
    placed = ranked_points(points, []).withColumns(terms).withColumn("_down", -F.col("p"))
    placed = running(placed, [], [value_level(F.col("_down"))], ["_down"], {f"{c}_before": ("sum", c) for c in ("_gain", "_loss")})
    sums = placed.agg(F.struct(*(F.sum(c).alias(c) for c in terms))).scalar()
    placed = placed.withColumn("_all", sums)
    positives, area = F.col("positives"), F.col("_all._area")
    fewer = (F.col("_all._gain") - F.col("_gain_before")) / positives
    own = F.when(n > 1, (pos - 1) * (tp - 1) / (n - 1)).otherwise(0.0) - F.col("_area")
    later = F.col("_all._loss") - F.col("_loss_before") - F.col("_loss")
    less = F.when(positives > 1, area / (positives * (positives - 1.0)) + (own - later) / (positives - 1)).otherwise(-area / positives)
    cases = F.array(F.struct((F.col("n") - pos).alias("w"), fewer.alias("change")), F.struct(pos.alias("w"), less.alias("change")))
    return placed.select(F.inline(cases)).where("w > 0")


def _acceleration(points):
    """BCa acceleration from leaving out each row; rows with equal score and label share one result."""
    changes = left_out(points)
    d = changes.agg((F.sum(F.col("change") * F.col("w")) / F.sum("w")).alias("m")).scalar() - F.col("change")
    moments = changes.select("w", d.alias("d")).agg(
        F.sum(F.col("d") * F.col("d") * F.col("d") * F.col("w")).alias("cubes"), F.sum(F.col("d") * F.col("d") * F.col("w")).alias("squares")
    ).first()
    return moments["cubes"] / (6 * moments["squares"] ** 1.5) if moments["squares"] else 0.0


# -- agreement -------------------------------------------------------------------------

def _kappa(counts):
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    po = (F.col("tp") + F.col("tn")) / n
    pe = (F.col("tp") + F.col("fn")) / n * ((F.col("tp") + F.col("fp")) / n) + (F.col("fp") + F.col("tn")) / n * ((F.col("fn") + F.col("tn")) / n)
    return counts.withColumn("n", n).withColumn("po", po).withColumn("pe", pe).withColumn(
        "kappa", F.when(F.col("pe") == 1.0, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    ).withColumn(
        "interpretation",
        F.when(F.col("kappa") < 0, "Poor (below chance)").when(F.col("kappa") < 0.20, "Slight").when(F.col("kappa") < 0.40, "Fair")
        .when(F.col("kappa") < 0.60, "Moderate").when(F.col("kappa") < 0.80, "Substantial").otherwise("Almost perfect"),
    )


def _agreement_counts(df, a, b):
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    return df.agg(
        F.count_if(x & y).alias("tp"), F.count_if(~x & ~y).alias("tn"), F.count_if(~x & y).alias("fp"), F.count_if(x & ~y).alias("fn")
    )


def cohens_kappa(df, a, b):
    """Agreement counts, observed and expected agreement, kappa and its label; one row."""
    return _kappa(_agreement_counts(df, a, b)).select("tp", "tn", "fp", "fn", "n", "po", "pe", "kappa", "interpretation")


def agreement_metrics(df, heuristic, human):
    """Precision, recall and F1 of the heuristic against the human label, with counts and kappa; one row."""
    counts = df.agg(
        F.count_if(F.col(heuristic) & F.col(human)).alias("tp"), F.count_if(~F.col(heuristic) & ~F.col(human)).alias("tn"),
        F.count_if(F.col(heuristic) & ~F.col(human)).alias("fp"), F.count_if(~F.col(heuristic) & F.col(human)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _kappa(counts).select(
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "tp", "fp", "fn", (tp + fn).alias("n_positive_human"), (tp + fp).alias("n_positive_heuristic"), "kappa",
        F.col("interpretation").alias("kappa_interpretation"), F.col("n").alias("support"),
    )


def lift_vs_prevalence(evaluation):
    """Linear trend and correlation of lift on prevalence over repositories."""
    return evaluation.agg(
        F.regr_slope("lift", "prevalence").alias("slope"), F.regr_intercept("lift", "prevalence").alias("intercept"),
        F.corr("lift", "prevalence").alias("r"), F.count(F.lit(1)).alias("repos"),
    )


def retention(full, static, metrics=("pr_auc", "roc_auc", "lift")):
    """Per metric: mean of both engines over repositories and their ratio in percent."""
    a = full.agg(*[F.avg(m).alias(m) for m in metrics])
    b = static.agg(*[F.avg(m).alias(m) for m in metrics])
    one = a.withColumn("_s", b.select(F.struct(*metrics)).scalar())
    return one.select(
        F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("full_engine"), F.col(f"_s.{m}").alias("static_engine"),
                     (F.try_divide(F.col(f"_s.{m}"), F.col(m)) * 100).alias("retention_pct"))
            for m in metrics
        ]))
    )


def top_results(results, column, n):
    """The n best rows by a column, each with the mean of the column over all rows."""
    mean = results.agg(F.avg(column).alias("m")).scalar()
    return results.withColumn(f"mean_{column}", mean).orderBy(F.desc(column), "repo").limit(n)
