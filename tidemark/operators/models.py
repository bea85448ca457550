"""Two-stage boosted forecasts with Spark's own learners: the chance of any purchase, and the amount if there is one."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.evaluation import auc, expanding_folds, hurdle_log, logloss, rmsle


def _fit(rows: DataFrame, features: list[str], learner) -> object:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), learner]).fit(rows)


def fit_hurdle(train: DataFrame, features: list[str], trees: int = 20, depth: int = 4, weight: str | None = None, validation: str | None = None, seed: int = 7):
    """(classifier, regressor): of target > 0 over all rows, of log1p(target) over rows with a positive target.

    weight names a column of row weights; validation a boolean column of rows that stop the boosting early.
    """
    extra = {k: v for k, v in (("weightCol", weight), ("validationIndicatorCol", validation)) if v}
    rows = train.withColumns({"label": (F.col("target") > 0).cast("double"), "label_log": F.log1p("target")})
    classifier = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, **extra)
    regressor = GBTRegressor(featuresCol="features", labelCol="label_log", predictionCol="positive_log", maxIter=trees, maxDepth=depth, seed=seed, **extra)
    return _fit(rows, features, classifier), _fit(rows.where("target > 0"), features, regressor)


def predict_hurdle(models, rows: DataFrame, gamma: float = 1.0) -> DataFrame:
    """rows with probability, positive_prediction, pred_log and predict."""
    classifier, regressor = models
    scored = classifier.transform(rows).withColumn("_p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction", "probability").withColumnRenamed("_p", "probability")
    scored = regressor.transform(scored).drop("features")
    scored = scored.withColumn("positive_prediction", F.expm1(F.greatest(F.lit(0.0), F.col("positive_log")))).drop("positive_log")
    return scored.withColumn("pred_log", hurdle_log(F.col("probability"), F.col("positive_prediction"), gamma)).withColumn("predict", F.expm1("pred_log"))


#: What the boosted hurdle learns with, unless told otherwise.
BOOSTED = boosting.Options(trees=20, depth=3, rate=0.2, bins=48, patience=10)


def fit_boosted_hurdle(train: DataFrame, features: list[str], weight: str | None = None, options: boosting.Options = BOOSTED, held: int = 10):
    """(classifier, regressor) over histograms: of target > 0 over all rows, of log1p(target) over rows with a positive target.

    Every held-th user, by a hash, isn't learned from but stops the boosting of both.
    """
    rows = train.withColumns({"_any": (F.col("target") > 0).cast("double"), "_log": F.log1p("target"), "_held": F.pmod(F.xxhash64("user_id"), F.lit(held)) == 0})
    classifier = boosting.fit(rows, features, "_any", weight, "_held", replace(options, loss="logistic"))
    return classifier, boosting.fit(rows.where("target > 0"), features, "_log", weight, "_held", replace(options, loss="squared"))


def predict_boosted_hurdle(models, rows: DataFrame, gamma: float = 1.0) -> DataFrame:
    """rows with probability, positive_prediction, pred_log and predict."""
    classifier, regressor = models
    scored = regressor.predict(classifier.predict(rows, "probability"), "_positive_log")
    out = scored.withColumn("positive_prediction", F.expm1(F.greatest(F.lit(0.0), F.col("_positive_log")))).drop("_positive_log")
    out = out.withColumn("pred_log", hurdle_log(F.col("probability"), F.col("positive_prediction"), gamma))
    return out.withColumn("predict", F.expm1("pred_log"))


def backtest(rows: DataFrame, features: list[str], snapshots: list[str], first: int = 2, **options) -> DataFrame:
    """Out-of-fold predictions over expanding windows of snapshots, with fold. A model is fitted for each fold."""
    parts = []
    for fold, train, valid in expanding_folds(snapshots, first):
        models = fit_hurdle(rows.where(F.col("snapshot_name").isin(*train)), features, **options)
        parts.append(predict_hurdle(models, rows.where(F.col("snapshot_name") == valid)).withColumn("fold", F.lit(fold)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_scores(predictions: DataFrame) -> DataFrame:
    """fold, rmsle, auc and logloss of out-of-fold predictions (of backtest); auc is null where a fold has one class alone."""
    seen = predictions.withColumn("positive", (F.col("target") > 0).cast("int"))
    scores = seen.groupBy("fold").agg(rmsle(F.col("target"), F.col("pred_log")).alias("rmsle"), logloss(F.col("positive"), F.col("probability")).alias("logloss"))
    return scores.join(auc(seen, "positive", "probability", keys=("fold",)), "fold")


def accepted(scores: DataFrame, baseline: float, min_gain: float = 0.001) -> float | None:
    """The mean rmsle of the folds if it is better than the baseline's by min_gain at least, else None."""
    mean = scores.agg(F.avg("rmsle")).first()[0]
    return mean if mean is not None and baseline - mean >= min_gain else None


#: Numbers of features that a sweep tries.
SWEEP = (45, 100, 200, 300, 400, 500, 600)


def top_feature_sweep(train: DataFrame, valid: DataFrame, ranked: list[str], sizes: tuple[int, ...] = SWEEP, **options) -> list[tuple[int, float]]:
    """(size, rmsle on valid), best first, of models fitted on the first so many of the features, which are ranked by importance.

    Sizes beyond the number of features count as all of them, once.
    """
    found = []
    for size in sorted({min(n, len(ranked)) for n in sizes}):
        scored = predict_hurdle(fit_hurdle(train, ranked[:size], **options), valid)
        found.append((size, scored.agg(rmsle(F.col("target"), F.col("pred_log"))).first()[0]))
    return sorted(found, key=lambda x: (x[1], x[0]))


def feature_importance(model, features: list[str], most: int = 45) -> list[tuple[str, float]]:
    """The features that a fitted pipeline used most."""
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, weights), strict=True), key=lambda x: (-x[1], x[0]))[:most]
