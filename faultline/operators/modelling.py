"""Preprocessing, classifiers, calibration, screening and experiments on Spark ML."""

import hashlib
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from faultline.operators import cells, evaluation, experiments, folds
from faultline.operators.features import GROUPS
from faultline.operators.running import hash_level, ranked, running, value_level
from faultline.operators.scoring import clip_probability, risk_tier
from faultline.session import materialize

LABEL = "future_bug_fix"


def doubles(df, columns):
    return df.select(*[c for c in df.columns if c not in columns], *[F.col(c).cast("double").alias(c) for c in columns])


def medians(df, columns):
    """The lower median of each column, exact: the value at place ceil(n / 2) of those that are neither null nor NaN.

    Values are counted first, so no task and not the driver holds a column.
    """
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])))
    counts = materialize(cells.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("_count")), "values")
    upto = running(counts, ["feature"], [value_level(F.col("x"))], ["x"], {"_upto": ("sum", "_count")}, inclusive=True)
    sizes = counts.groupBy("feature").agg(F.sum("_count").alias("_n"))
    found = upto.join(sizes, "feature").where(F.col("_upto") * 2 >= F.col("_n")).groupBy("feature").agg(F.min("x").alias("x")).collect()  # a row for each column
    table = {r["feature"]: r["x"] for r in found}
    empty = [c for c in columns if c not in table]
    if empty:
        raise ValueError(f"no median of {empty}: all values are missing")
    return table


def preprocessor(train, columns):
    """Pipeline stages (assembly with missing flags where train has gaps, standard scaling), the flagged columns and the medians that
    fill gaps. Fit on train only."""
    gaps = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    flagged = [c for c in columns if gaps[c] > 0]
    stages = [
        VectorAssembler(inputCols=[f"{c}__filled" for c in columns] + [f"{c}__missing" for c in flagged], outputCol="raw_features"),
        StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="features"),
    ]
    return stages, flagged, medians(train, columns)


def with_flags(df, flagged, fills):
    """df with the columns of `fills`, their gaps filled, and the flags of those that had any."""
    filled = [F.when(F.col(c).isNull() | F.isnan(c), F.lit(v)).otherwise(F.col(c)).alias(f"{c}__filled") for c, v in fills.items()]
    return df.select("*", *filled, *[F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in flagged])


def with_class_weights(df, label=LABEL, copies=None):
    """Balanced weights n / (2 * n of the class), from one aggregate; a row counts `copies` times where that column is named."""
    one = F.lit(1) if copies is None else F.col(copies)
    counts = df.agg(F.struct(F.sum(one).alias("n"), F.sum(F.col(label) * one).alias("p")).alias("c")).scalar()
    weighted = df.withColumn("_c", counts)
    share = F.when(F.col(label) == 1, F.col("_c.p")).otherwise(F.col("_c.n") - F.col("_c.p"))
    return weighted.withColumn("class_weight", F.col("_c.n") / (share * 2.0)).drop("_c")


def classifier(name, **overrides):
    """A fresh classifier: logistic_regression, random_forest or boosted."""
    settings = {
        "logistic_regression": (LogisticRegression, dict(regParam=0.01, elasticNetParam=0.0, maxIter=100)),
        # a row's node in each tree is kept from level to level, not looked up from the root again; the model is the same
        "random_forest": (RandomForestClassifier, dict(numTrees=300, maxDepth=10, seed=42, cacheNodeIds=True)),
        "boosted": (GBTClassifier, dict(maxIter=300, maxDepth=5, stepSize=0.05, seed=42)),
    }
    if name not in settings:
        raise ValueError(f"Unknown model: {name}")
    kind, defaults = settings[name]
    return kind(featuresCol="features", labelCol=LABEL, weightCol="class_weight", **{**defaults, **overrides})


class Fitted:
    """A fitted pipeline with the flags and medians its inputs need, and the borders where it was fitted on cells."""

    def __init__(self, model, columns, flagged, fills, borders=None):
        self.model, self.columns, self.flagged, self.fills, self.borders = model, columns, flagged, fills, borders

    def prepare(self, df):
        ready = with_flags(doubles(df, self.columns), self.flagged, self.fills)
        return ready if self.borders is None else cells.cut(ready, self.borders)

    def score(self, df, out="p"):
        """Add the probability of the positive class. Fitted on cells, the model scores each cell of df once."""
        if self.borders is not None:
            cell = [*self.borders, *[f"{c}__missing" for c in self.flagged]]
            rows = self.prepare(df)
            scored = self.model.transform(rows.select(*cell).distinct()).withColumn(out, vector_to_array("probability")[1])
            return rows.drop(out).join(scored.select(*cell, out), cell).select(*[c for c in df.columns if c != out], out)
        scored = self.model.transform(self.prepare(df)).withColumn(out, vector_to_array("probability")[1])
        return scored.select(*df.columns, out)


#: Rows times trees that one task of a forest's fit goes through at a level: 20,000 rows of 300 trees.
VISITS_A_TASK = 6_000_000


def dealt(df, trees):
    """df in even parts of at most VISITS_A_TASK rows times trees; as it is where its own parts are no larger. Rows are narrow, so the
    bytes of their files ask for too few tasks."""
    sizes = df.select(F.spark_partition_id().alias("part")).groupBy("part").count()
    rows, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    return df.repartition(-(-rows * trees // VISITS_A_TASK)) if (largest or 0) * trees > VISITS_A_TASK else df


#: Rows times trees beyond which a forest is fitted on cells: 100,000 rows of 300 trees.
VISITS_BY_ROWS = 30_000_000


def train(df, columns, name, **overrides):
    """A fitted classifier. Boosted trees, and forests beyond VISITS_BY_ROWS, are fitted on the cells that the borders of the columns
    cut the rows into, so their levels do not pass over the rows."""
    ready = doubles(df.select(LABEL, *columns), columns)
    stages, flagged, fills = preprocessor(ready, columns)
    fresh = classifier(name, **overrides)
    if name == "boosted" or (name == "random_forest" and df.count() * fresh.getNumTrees() > VISITS_BY_ROWS):
        borders = cells.borders(with_flags(ready, flagged, fills), [f"{c}__filled" for c in columns], fresh.getMaxBins())
        table = cells.table(with_flags(ready, flagged, fills), borders, [f"{c}__missing" for c in flagged], LABEL)
        assembler = stages[0].setOutputCol("features")
        fitted = cells.fit(assembler.transform(with_class_weights(table, copies="copies")), fresh, LABEL)
        return Fitted(PipelineModel([assembler, fitted]), columns, flagged, fills, borders)
    weighted = with_class_weights(with_flags(ready, flagged, fills))
    if name == "random_forest":
        weighted = dealt(weighted.drop(*columns), fresh.getNumTrees())
    model = Pipeline(stages=[*stages, fresh]).fit(weighted)
    return Fitted(model, columns, flagged, fills)


def preprocess(df, train_rows, columns):
    """Imputed, flagged and scaled features of df by statistics of train_rows, as an array column."""
    ready = doubles(train_rows, columns)
    stages, flagged, fills = preprocessor(ready, columns)
    model = Pipeline(stages=stages).fit(with_flags(ready, flagged, fills))
    done = model.transform(with_flags(doubles(df, columns), flagged, fills))
    return done.select(*[c for c in df.columns if c not in columns], vector_to_array("features").alias("features"))


# -- calibration -------------------------------------------------------------------------

def _logit(p):
    inner = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(inner / (1 - inner))


def calibrate_sigmoid(held_out, p="p", label=LABEL):
    """Platt scaling fitted on held-out scores; returns a function adding calibrated p to a frame."""
    assemble = VectorAssembler(inputCols=["_margin"], outputCol="_vector")
    fit_on = assemble.transform(held_out.withColumn("_margin", _logit(F.col(p))))
    model = LogisticRegression(featuresCol="_vector", labelCol=label, maxIter=50).fit(fit_on)
    slope, intercept = float(model.coefficients[0]), float(model.intercept)
    return lambda df, p=p: df.withColumn("calibrated", 1.0 / (1.0 + F.exp(-(F.lit(slope) * _logit(F.col(p)) + intercept))))


def calibrate_isotonic(held_out, p="p", label=LABEL):
    """Isotonic calibration; equal scores are averaged first, so the fit sees distinct scores with weights."""
    points = held_out.groupBy(F.col(p).alias("_x")).agg(F.avg(label).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w"))
    model = IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="calibrated").fit(points)
    return lambda df: model.transform(df.withColumn("_x", F.col(p))).drop("_x")


# -- experiments ---------------------------------------------------------------------------

def group_columns(df, group, removed=()):
    return [c for c in GROUPS[group] if c in df.columns and c not in set(removed)]


def temporal_rows(df, n_folds=10, file="canonical_file_id", min_train=folds.MIN_TRAIN, min_test=folds.MIN_TEST):
    """df with the folds that each row trains and tests in (lo, hi, hole, test_fold), and their number; raises where a fold is too
    small, shares a file between its sides or tests no later than it trains."""
    rows = materialize(folds.fold_intervals(df, n_folds, file), "folds")
    folds.require_clean(folds.interval_checks(rows, file, min_train, min_test), "temporal folds")
    n = rows.agg(F.max("n_folds")).first()[0] or 0
    member = rows.withColumns({"lo": F.col("train_from"), "hi": F.lit(n), "hole": F.lit(-1), "_key": F.col("test_fold").cast("string")})
    return member.drop("ts", "train_from", "n_folds"), {str(f): f for f in range(n)}


def lopo_rows(df, min_train=folds.MIN_TRAIN, min_test=folds.MIN_TEST):
    """df with the same columns, a fold for each repository that others are left to train for; raises where one is too small."""
    sizes = folds.lopo_folds(df).orderBy("held_out").collect()  # a row for each repository
    small = [r["held_out"] for r in sizes if r["train_rows"] < min_train or r["test_rows"] < min_test]
    if small:
        raise ValueError(f"lopo folds: too small in {small[:5]}")
    names = {r["held_out"]: f for f, r in enumerate(sizes)}
    table = df.sparkSession.createDataFrame(list(names.items()), "repo string, test_fold int")
    rows = df.join(table, "repo").withColumns({"lo": F.lit(0), "hi": F.lit(len(names)), "hole": F.col("test_fold"), "_key": F.col("repo")})
    return materialize(rows, "folds"), names


#: Fits that run at the same time.
POOL = 4


def _tree_scores(rows, n_folds, columns, name, overrides):
    """Scores of every fold, a fit for each, POOL at a time on one written table."""
    def one(fold):
        trained = rows.where((F.col("lo") <= fold) & (F.col("hi") > fold) & (F.col("hole") != fold))
        fitted = train(trained, columns, name, **overrides)
        scored = fitted.score(rows.where(F.col("test_fold") == fold)).select("_key", F.col("test_fold").alias("fold"), F.col(LABEL).cast("double").alias("y"), "p")
        return materialize(scored, "fold-scores")

    with ThreadPoolExecutor(POOL) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(one), range(n_folds)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def fold_scores(rows, n_folds, columns, name, overrides):
    """(_key, fold, y, p): every test row scored by the model of its fold."""
    if not n_folds:
        return rows.sparkSession.createDataFrame([], "_key string, fold int, y double, p double")
    if name != "logistic_regression":
        return _tree_scores(rows, n_folds, columns, name, overrides)
    table, flagged, scales = experiments.prepared(rows, columns, ["_key"])
    fitted = experiments.fit(table, flagged, scales, columns, n_folds, overrides.get("regParam", experiments.PENALTY))
    return experiments.scores(table, fitted, ["_key"])


KEYS = ["regime", "model", "feature_group", "key"]


def _evaluated(scored, regime, name, group):
    return evaluation.fold_metrics(
        scored.select(F.lit(regime).alias("regime"), F.lit(name).alias("model"), F.lit(group).alias("feature_group"), F.col("_key").alias("key"), "y", "p"), KEYS
    )


def run_temporal_cv(df, name, group, n_folds=10, file="canonical_file_id", min_train=folds.MIN_TRAIN, min_test=folds.MIN_TEST, **overrides):
    """Metrics of each time-ordered fold: (regime, model, feature_group, key, pr_auc, ...); the folds are checked first."""
    rows, names = temporal_rows(df, n_folds, file, min_train, min_test)
    return _evaluated(fold_scores(rows, len(names), group_columns(df, group), name, overrides), "temporal_cv", name, group)


def run_lopo(df, name, group, min_train=folds.MIN_TRAIN, min_test=folds.MIN_TEST, **overrides):
    """Metrics of each repository by models of all others; the folds are checked first."""
    rows, names = lopo_rows(df, min_train, min_test)
    return _evaluated(fold_scores(rows, len(names), group_columns(df, group), name, overrides), "lopo", name, group)


def run_all(df, names, groups, n_folds=10, file="canonical_file_id", overrides=None, min_train=folds.MIN_TRAIN, min_test=folds.MIN_TEST):
    """Every model on every group in both regimes: one long results table. Each regime's folds are made, checked and written once."""
    regimes = {"temporal_cv": temporal_rows(df, n_folds, file, min_train, min_test), "lopo": lopo_rows(df, min_train, min_test)}
    parts = []
    for name in names:
        for group in groups:
            for regime, (rows, keys) in regimes.items():
                scored = fold_scores(rows, len(keys), group_columns(df, group), name, (overrides or {}).get(name, {}))
                parts.append(materialize(_evaluated(scored, regime, name, group), "results"))
    return reduce(lambda a, b: a.unionByName(b), parts)


class Calibrated:
    """The mean of several fits, each with its own sigmoid."""

    def __init__(self, fits):
        self.fits = fits

    def score(self, df, out="p"):
        """Add the calibrated probability of the positive class."""
        scored = df
        for k, (fitted, calibrate) in enumerate(self.fits):
            scored = calibrate(fitted.score(scored, "_p"), "_p").withColumnRenamed("calibrated", f"_p{k}").drop("_p")
        mean = reduce(lambda a, b: a + b, [F.col(f"_p{k}") for k in range(len(self.fits))]) / len(self.fits)
        return scored.withColumn(out, mean).select(*df.columns, out)


def refit_best(df, results, key, overrides=None, parts=2):
    """(model, feature group, Calibrated): the configuration of highest mean PR-AUC, fitted on all rows but a part, and its sigmoid on that
    part, for each of `parts` parts by a hash of `key`."""
    best = evaluation.best_config(results).first()
    name, columns = best["model"], group_columns(df, best["feature_group"])
    place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])), 1, 8), 16, 10).cast("long"), F.lit(parts))
    dealt = materialize(df.withColumn("_part", place), "refit")
    fits = []
    for k in range(parts):
        fitted = train(dealt.where(F.col("_part") != k), columns, name, **(overrides or {}).get(name, {}))
        fits.append((fitted, calibrate_sigmoid(fitted.score(dealt.where(F.col("_part") == k)))))
    return name, best["feature_group"], Calibrated(fits)


def tune(df, columns, name, grid, n_folds=4, file="canonical_file_id", min_train=folds.MIN_TRAIN, min_test=folds.MIN_TEST):
    """Mean PR-AUC over time-ordered folds for each setting of a small grid, best first."""
    rows, names = temporal_rows(df, n_folds, file, min_train, min_test)
    out = None
    for setting in grid:
        scored = fold_scores(rows, len(names), columns, name, setting)
        table = evaluation.average_precision(scored.select("_key", "y", "p"), ["_key"]).agg(F.avg("pr_auc").alias("mean_pr_auc"))
        row = table.select(F.lit(str(setting)).alias("setting"), "mean_pr_auc")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("mean_pr_auc"), "setting")


# -- screening -----------------------------------------------------------------------------

def _correlations(df, columns):
    """(names with variance, their correlation matrix), one Spark job; the matrix has one cell per column pair."""
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    spread = filled.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    varied = [c for c in columns if spread[c] and spread[c] > 0]
    vectors = VectorAssembler(inputCols=varied, outputCol="v").transform(filled)
    return varied, Correlation.corr(vectors, "v").first()[0].toArray()


def _vif_values(matrix):
    """1 / (1 - R^2) of each column on the others, from the inverse of the correlation matrix."""
    k = matrix.shape[0]
    values = []
    for i in range(k):
        others = [j for j in range(k) if j != i]
        if not others:
            values.append(1.0)
            continue
        r = matrix[i, others]
        r2 = float(r @ np.linalg.lstsq(matrix[np.ix_(others, others)], r, rcond=None)[0])
        values.append(round(1.0 / (1.0 - r2), 2) if r2 < 0.9999 else 10000.0)
    return values


def vif(spark, df, columns):
    """Rows (feature, vif), null for constant columns."""
    varied, matrix = _correlations(df, columns)
    table = dict(zip(varied, _vif_values(matrix)))
    return spark.createDataFrame([(c, table.get(c)) for c in columns], "feature string, vif double")


def vif_screen(spark, df, columns, threshold=10.0, protect=()):
    """Rows (feature, removed_at): the step a feature was dropped at, null when kept.

    The highest value above the threshold goes first; every step works on a part of
    the one matrix, so no further job runs.
    """
    varied, matrix = _correlations(df, columns)
    kept, removed = list(range(len(varied))), {}
    while True:
        values = _vif_values(matrix[np.ix_(kept, kept)])
        open_to = [(v, -n, i) for n, (v, i) in enumerate(zip(values, kept)) if varied[i] not in protect]
        if not open_to or max(open_to)[0] <= threshold:
            break
        worst = max(open_to)[2]
        kept.remove(worst)
        removed[varied[worst]] = len(removed) + 1
    return spark.createDataFrame([(c, removed.get(c)) for c in columns], "feature string, removed_at int")


def correlation_matrix(df, columns):
    """Lower triangle of the Pearson matrix as rows (a, b, r), one aggregate."""
    pairs = [(columns[i], columns[j]) for i in range(len(columns)) for j in range(i)]
    cast = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    wide = cast.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("r")) for k, (a, b) in enumerate(pairs)]))
    )


# -- explanation ------------------------------------------------------------------------------

def linear_contributions(df, coefficients):
    """Mean absolute contribution coef * (x - mean) per feature of a linear model."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in coefficients])).scalar()
    placed = df.withColumn("_m", means)
    parts = [
        F.struct(F.lit(c).alias("feature"), F.abs(F.lit(float(w)) * (F.col(c) - F.col(f"_m.{c}"))).alias("v")) for c, w in coefficients.items()
    ]
    return placed.select(F.inline(F.array(*parts))).groupBy("feature").agg(F.avg("v").alias("importance"))


class LinearScore:
    """A given linear score in place of a fitted model."""

    def __init__(self, weights):
        self.weights, self.columns = weights, list(weights)

    def score(self, df, out="p"):
        return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(c).cast("double") * F.lit(float(w)) for c, w in self.weights.items()]))


def shifts(columns, n, seed=42):
    """How far each column moves along the numbered rows: 1 to n - 1, from md5("seed|column")."""
    return {c: 1 + int(hashlib.md5(f"{seed}|{c}".encode()).hexdigest()[:8], 16) % (n - 1) if n > 1 else 0 for c in columns}


def shuffled(df, columns, key, seed=42):
    """df with `_shuffled`, a struct of the columns' values from other rows, each column permuted by itself.

    Rows are numbered once, in the order of md5("seed|key"), a random one; a column's values move along that order by a distance of
    its own, around the end. So one numbering and one exchange shuffle all columns, every value goes to one row, and
    none stays where it was. `key` must tell the rows apart.
    """
    ident = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    hashed = df.withColumn("_h", F.md5(ident))
    numbered = materialize(ranked(hashed, [], [hash_level(F.col("_h"))], ["_h", *key], "_place").drop("_h"), "numbered")
    n = numbered.count()
    by = shifts(columns, n, seed)
    gifts = F.array(*[F.struct(F.lit(i).alias("i"), F.pmod(F.col("_place") - by[c], F.lit(max(1, n))).alias("to"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    taken = numbered.select(F.inline(gifts)).groupBy("to").agg(F.struct(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(c) for i, c in enumerate(columns)]).alias("_shuffled"))
    return numbered.join(taken, F.pmod(F.col("_place"), F.lit(max(1, n))) == F.col("to")).select(*df.columns, "_shuffled")


def permutation_importance(fitted, df, key, columns=None, seed=42):
    """Loss of PR-AUC when a feature is shuffled, per feature. Rows are written out once for each feature, the shuffled value in its
    place, and all are scored in one pass; the counts per distinct score are written, and cut into even ranges of them: the scores of
    a weak model crowd."""
    columns = list(columns or fitted.columns)
    rows = shuffled(df, columns, key, seed)
    cases = [F.struct(F.lit(c).alias("feature"), *[(F.col("_shuffled")[x] if x == c else F.col(x).cast("double")).alias(x) for x in fitted.columns]) for c in ("", *columns)]
    scored = fitted.score(rows.select(LABEL, F.inline(F.array(*cases))))
    points = materialize(evaluation.score_points(scored, ["feature"], y=LABEL), "points")
    dealt = materialize(points.repartitionByRange("feature", -F.col("p")).withColumn("_part", F.spark_partition_id()), "dealt")
    placed = evaluation.ranked_points(dealt, ["feature"], F.when(F.col("p").isNotNull(), F.col("_part")))
    areas = materialize(evaluation.precision_areas(placed, ["feature"]), "importance")
    base = areas.where("feature = ''").select("pr_auc").scalar()
    return areas.where("feature <> ''").select("feature", (base - F.col("pr_auc")).alias("importance"))


def score_batch(features, models, heuristic):
    """Clipped probability, tier and engine of each row, in one pass.

    `engine` says which of `models`, a map from engine to fitted model, a row goes to: each model adds its score and the row's engine
    picks. A row whose engine has no model goes to the static one, and without that, or without a score, keeps the heuristic.
    """
    scored, names = features, {}
    for name, fitted in models.items():
        names[name] = f"_ml_{name}"
        scored = fitted.score(scored, names[name])
    used, value = F.lit("heuristic_fallback"), F.lit(None).cast("double")
    if "static" in names:
        used, value = F.lit("static"), F.col(names["static"])
    for name in names:
        if name != "static":
            own = F.col("engine") == name
            used, value = F.when(own, name).otherwise(used), F.when(own, F.col(names[name])).otherwise(value)
    scored = scored.withColumns({"_ml": value, "_used": F.when(value.isNull(), "heuristic_fallback").otherwise(used)})
    risk = F.round(clip_probability(F.coalesce(F.col("_ml"), heuristic)), 4)
    scored = scored.withColumn("risk_probability", risk).withColumn("risk_tier", risk_tier(F.col("risk_probability")))
    return scored.withColumn("engine", F.col("_used")).drop("_ml", "_used", *names.values())
