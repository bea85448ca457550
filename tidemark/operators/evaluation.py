"""Scores, hurdle predictions and parameter grids over prediction tables.

A grid never multiplies the rows by all its points where the score is a polynomial in a parameter: then one pass sums the
moments, and the grid is arithmetic over a few sums. Only clipped scores are exploded over their parameter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidemark.operators.quantiles import exact_quantiles
from tidemark.functions.expr import logit, sigmoid
from tidemark.operators.guards import require_unique


def rmsle(target: Column, predicted_log: Column) -> Column:
    """An aggregate: root of the mean squared difference to log1p(target)."""
    return F.sqrt(F.avg(F.pow(F.log1p(target) - predicted_log, F.lit(2))))


def logloss(positive: Column, probability: Column, edge: float = 1e-6) -> Column:
    p = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), probability))
    return -F.avg(positive * F.ln(p) + (1 - positive) * F.ln(1 - p))


def auc(df: DataFrame, positive: str, probability: str, bins: int = 1024, keys: tuple[str, ...] = ()) -> DataFrame:
    """auc for each value of the keys, or in one row; exact with ties counted half, null where there is one class alone.

    Ranks are summed by bin first, so no task sorts all rows.
    """
    by = df.groupBy(*keys, F.col(probability).alias("p")).agg(F.sum(F.col(positive)).alias("pos"), F.sum(1 - F.col(positive)).alias("neg"))
    by = by.withColumn("bin", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p"))) * bins))
    per_bin = by.groupBy(*keys, "bin").agg(F.sum("neg").alias("n"))
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most bins + 1 rows
    below_bin = per_bin.select(*keys, "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*keys, "bin").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("inner", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(below_bin, [*keys, "bin"])
    pairs = F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))
    return ranked.groupBy(*keys).agg((F.sum(F.col("pos") * (F.col("before") + F.col("inner") + F.col("neg") / 2)) / pairs).alias("auc"))


def hurdle_log(probability: Column, positive_prediction: Column, gamma: float | Column = 1.0, scale: float | Column = 1.0) -> Column:
    """p ** gamma * scale * log1p(prediction if positive), not below 0."""
    g, s = (x if isinstance(x, Column) else F.lit(x) for x in (gamma, scale))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability))
    return F.greatest(F.lit(0.0), F.pow(p, g) * s * F.log1p(F.greatest(F.lit(0.0), positive_prediction)))


def hurdle_combine(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """df with base_hurdle_log, base_hurdle_predict and target_log."""
    return df.withColumn("base_hurdle_log", hurdle_log(F.col("probability"), F.col("positive_prediction"), gamma)).withColumns(
        {"base_hurdle_predict": F.expm1("base_hurdle_log"), "target_log": F.log1p("target")}
    )


def residuals(df: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """df (of hurdle_combine) with residual, residual_abs and residual_clipped at its quantiles.

    The quantiles are exact and found by distributed selection.
    """
    df = df.withColumn("residual", F.col("target_log") - F.col("base_hurdle_log"))
    least, most = exact_quantiles(df.select(F.lit("residual").alias("name"), F.col("residual").alias("value")), {"residual": [low, high]})["residual"]
    clipped = F.greatest(F.least("residual", F.lit(most).cast("double")), F.lit(least).cast("double"))
    return df.withColumns({"residual_abs": F.abs("residual"), "residual_clipped": clipped})


def _steps(first: float, last: float, step: float) -> list[float]:
    return [round(first + k * step, 4) for k in range(round((last - first) / step) + 1)]


def alpha_grid(df: DataFrame, alphas: list[float] | None = None) -> DataFrame:
    """alpha, fold (null: all folds), rmsle of max(base + alpha * residual, 0). Clipped, so rows meet every alpha."""
    alphas = alphas or _steps(-0.3, 0.3, 0.005)
    met = df.select("fold", "target_log", "base_hurdle_log", "residual_prediction", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha"))
    final = F.greatest(F.lit(0.0), F.col("base_hurdle_log") + F.col("alpha") * F.col("residual_prediction"))
    by = met.groupBy("alpha", "fold").agg(F.sum(F.pow(F.col("target_log") - final, F.lit(2))).alias("se"), F.count("*").alias("n"))
    return by.rollup("alpha", "fold").agg(F.sqrt(F.sum("se") / F.sum("n")).alias("rmsle")).where("alpha is not null")


def chosen_alpha(grid: DataFrame, min_gain: float = 0.001) -> float:
    """The best pooled alpha if it gains enough over 0, else 0. Ties go to the smaller alpha."""
    pooled = {r["alpha"]: r["rmsle"] for r in grid.where("fold is null").collect()}
    best = min(pooled, key=lambda a: (pooled[a], a))
    return best if pooled[0.0] - pooled[best] >= min_gain else 0.0


def platt_grid(df: DataFrame) -> DataFrame:
    """a, b, logloss of sigmoid(a * logit(p) + b) over 9 x 7 points."""
    points = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in _steps(0.8, 1.2, 0.05) for b in _steps(-0.15, 0.15, 0.05)])
    met = df.select(F.col("positive"), logit(F.col("probability")).alias("z"), F.explode(points).alias("point"))
    return met.groupBy("point.a", "point.b").agg(logloss(F.col("positive"), sigmoid(F.col("point.a") * F.col("z") + F.col("point.b"))).alias("logloss"))


def platt_calibrated(df: DataFrame, name: str = "probability_platt") -> DataFrame:
    """df with the probability moved by the point of platt_grid that has the least log loss; ties go to the smaller point."""
    best = platt_grid(df).orderBy("logloss", "a", "b").first()
    a, b = (best["a"], best["b"]) if best else (1.0, 0.0)
    return df.withColumn(name, sigmoid(F.lit(a) * logit(F.col("probability")) + F.lit(b)))


def gamma_scale_grid(df: DataFrame, probabilities: tuple[str, ...] = ("probability",), gammas: list[float] | None = None, scales: list[float] | None = None) -> DataFrame:
    """probability, gamma, scale, rmsle, worst and std over snapshots, stable_score = rmsle + std / 4.

    The squared error is quadratic in the scale, so rows meet the gammas only and scales multiply sums.
    """
    gammas, scales = gammas or _steps(1.0, 1.15, 0.01), scales or _steps(0.96, 1.04, 0.01)
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("p")) for n in probabilities])
    met = df.select("snapshot_name", F.log1p("target").alias("t"), F.col("positive_prediction"), F.explode(names).alias("x"))
    met = met.select("*", F.explode(F.array(*[F.lit(g) for g in gammas])).alias("gamma")).withColumn("q", hurdle_log(F.col("x.p"), F.col("positive_prediction"), F.col("gamma")))
    sums = met.groupBy(F.col("x.name").alias("probability"), "gamma", "snapshot_name").agg(F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.count("*").alias("n"))
    each = sums.select("*", F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale")).withColumn("se", F.greatest(F.lit(0.0), F.col("tt") - 2 * F.col("scale") * F.col("tq") + F.col("scale") * F.col("scale") * F.col("qq")))
    own = F.sqrt(F.col("se") / F.col("n"))
    out = each.groupBy("probability", "gamma", "scale").agg(F.sqrt(F.sum("se") / F.sum("n")).alias("rmsle"), F.max(own).alias("worst_snapshot_rmsle"), F.coalesce(F.stddev_samp(own), F.lit(0.0)).alias("std_snapshot_rmsle"))
    return out.withColumn("stable_score", F.col("rmsle") + 0.25 * F.col("std_snapshot_rmsle"))


#: Points of a grid that are scored by snapshot and chosen from.
TOP = 120
#: Fixed points besides the best ones: a name, gamma and scale of the plain probability.
FIXED = (("raw_1.095_1.000", 1.095, 1.0), ("raw_1.100_1.005", 1.1, 1.005), ("raw_1.105_1.000", 1.105, 1.0), ("raw_1.100_0.995", 1.1, 0.995))


def top_points(grid: DataFrame, top: int = TOP) -> DataFrame:
    """The points of the least rmsle; ties go to the smaller point."""
    return grid.orderBy("rmsle", "probability", "gamma", "scale").limit(top)


def candidates(grid: DataFrame) -> DataFrame:
    """The grid's best points: by score, by stable score and by the worst snapshot, each with what it is best in."""
    pick = lambda kind, by: grid.orderBy(by, "probability", "gamma", "scale").limit(1).withColumn("best", F.lit(kind))
    return pick("global", "rmsle").unionByName(pick("stable", "stable_score")).unionByName(pick("worst", "worst_snapshot_rmsle"))


def submission_points(grid: DataFrame, raw: str = "probability") -> DataFrame:
    """best, probability, gamma, scale of the candidates among the grid's top points, of the baseline (gamma 1.1, scale 1) and of the fixed points."""
    best = candidates(top_points(grid)).select("best", "probability", "gamma", "scale")
    fixed = [("baseline", raw, 1.1, 1.0), *((name, raw, g, s) for name, g, s in FIXED)]
    return best.unionByName(grid.sparkSession.createDataFrame(fixed, best.schema))


def hurdle_submissions(df: DataFrame, points: DataFrame, probabilities: tuple[str, ...] = ("probability",)) -> DataFrame:
    """user_id, best, predict of the hurdle at each point (a handful of rows, broadcast)."""
    chosen = F.coalesce(*[F.when(F.col("x.probability") == n, F.col(n)) for n in probabilities])
    few = points.select(F.struct("best", "probability", "gamma", "scale").alias("x"))
    met = df.select("user_id", "positive_prediction", *probabilities).crossJoin(F.broadcast(few))
    return met.select("user_id", "x.best", F.expm1(hurdle_log(chosen, F.col("positive_prediction"), F.col("x.gamma"), F.col("x.scale"))).alias("predict"))


def final_submission(classifier: DataFrame, regressor: DataFrame, residual: DataFrame, alpha: float, gamma: float = 1.1) -> DataFrame:
    """user_id, predict: the hurdle plus alpha times the residual prediction, not below 0.

    classifier: user_id, probability; regressor: user_id, positive_prediction; residual: user_id, residual_prediction. All three
    must have the same users, each once; else ValueError.
    """
    for name, table in (("classifier", classifier), ("regressor", regressor), ("residual", residual)):
        require_unique(table, ["user_id"], name)
    out = classifier.select("user_id", "probability").join(regressor.select("user_id", "positive_prediction"), "user_id").join(residual.select("user_id", "residual_prediction"), "user_id")
    if out.count() != classifier.count():
        raise ValueError("users of the classifier lack in the other tables")
    log = hurdle_log(F.col("probability"), F.col("positive_prediction"), gamma) + F.lit(alpha) * F.col("residual_prediction")
    return out.select("user_id", F.expm1(F.greatest(F.lit(0.0), log)).alias("predict"))


def analog_log(last_year_log: Column, old: Column, new: Column, alpha: Column | float, clip: Column | float, k: Column | float) -> Column:
    """Last year's value moved by clipped growth, as far as the growth is supported; not below 0."""
    a, c, s = (x if isinstance(x, Column) else F.lit(x) for x in (alpha, clip, k))
    growth = F.greatest(-c, F.least(c, F.log1p(new) - F.log1p(old)))
    return F.greatest(F.lit(0.0), last_year_log + a * (old + new) / (old + new + s) * growth)


ANALOG_GAMMAS = tuple(_steps(0.9, 1.15, 0.01))
ANALOG_ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)
ANALOG_CLIPS = (0.5, 1.0, 1.5, 2.0)
ANALOG_KS = (10.0, 50.0, 100.0, 250.0)
ANALOG_WEIGHTS = tuple(_steps(0.05, 0.3, 0.025))


def analog_grid(df: DataFrame, gammas=ANALOG_GAMMAS, alphas=ANALOG_ALPHAS, clips=ANALOG_CLIPS, ks=ANALOG_KS, weights=ANALOG_WEIGHTS) -> DataFrame:
    """gamma, alpha, clip, k, weight and the scores of the base, of the analog and of their blend in log space.

    The blend's squared error is a quadratic in the weight, made of the three moments of both errors.
    """
    points = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(c).alias("clip"), F.lit(k).alias("k")) for a in alphas for c in clips for k in ks])
    met = df.select("target", "probability", "positive_prediction", "last_year", "old", "new", F.explode(points).alias("x"))
    met = met.withColumn("a", F.log1p("target") - analog_log(F.log1p("last_year"), F.col("old"), F.col("new"), F.col("x.alpha"), F.col("x.clip"), F.col("x.k")))
    met = met.select("*", F.explode(F.array(*[F.lit(g) for g in gammas])).alias("gamma")).withColumn("b", F.log1p("target") - hurdle_log(F.col("probability"), F.col("positive_prediction"), F.col("gamma")))
    m = met.groupBy("gamma", "x.alpha", "x.clip", "x.k").agg(F.avg(F.col("b") * F.col("b")).alias("bb"), F.avg(F.col("a") * F.col("a")).alias("aa"), F.avg(F.col("a") * F.col("b")).alias("ab"))
    w = F.col("weight")
    out = m.select("*", F.explode(F.array(*[F.lit(x) for x in weights])).alias("weight"))
    mse = (1 - w) * (1 - w) * F.col("bb") + 2 * w * (1 - w) * F.col("ab") + w * w * F.col("aa")
    return out.select("gamma", "alpha", "clip", "k", "weight", F.sqrt("bb").alias("base_rmsle"), F.sqrt("aa").alias("analog_rmsle"), F.sqrt(F.greatest(F.lit(0.0), mse)).alias("blend_rmsle"))


def analog_submissions(df: DataFrame, best: dict[str, float], weights: tuple[float, ...] = (0.05, 0.1, 0.15, 0.2, 0.25)) -> DataFrame:
    """user_id, weight, predict of the blend of hurdle and analog logs at one point (gamma, alpha, clip, k) and each weight."""
    base = hurdle_log(F.col("probability"), F.col("positive_prediction"), best["gamma"])
    analog = analog_log(F.log1p("last_year"), F.col("old"), F.col("new"), best["alpha"], best["clip"], best["k"])
    met = df.select("user_id", base.alias("b"), analog.alias("a"), F.explode(F.array(*[F.lit(w) for w in weights])).alias("weight"))
    return met.select("user_id", "weight", F.expm1(F.greatest(F.lit(0.0), (1 - F.col("weight")) * F.col("b") + F.col("weight") * F.col("a"))).alias("predict"))


def two_model_grid(df: DataFrame, first: str, second: str, points: int = 101) -> DataFrame:
    """alpha, rmsle of alpha * first + (1 - alpha) * second in log space, from three moments."""
    a, b = F.log1p("target") - F.col(first), F.log1p("target") - F.col(second)
    m = df.agg(F.avg(a * a).alias("aa"), F.avg(a * b).alias("ab"), F.avg(b * b).alias("bb"))
    w = F.col("alpha")
    out = m.select("*", F.explode(F.array(*[F.lit(round(i / (points - 1), 6)) for i in range(points)])).alias("alpha"))
    return out.select("alpha", F.sqrt(F.greatest(F.lit(0.0), w * w * F.col("aa") + 2 * w * (1 - w) * F.col("ab") + (1 - w) * (1 - w) * F.col("bb"))).alias("rmsle"))


def _simplex(gram: np.ndarray) -> np.ndarray:
    """Non-negative w with sum 1 and the least w' gram w; of equal ones (to 1e-9) that of the fewest models, the first of these."""
    found = []
    for size in range(1, len(gram) + 1):
        for support in combinations(range(len(gram)), size):
            g = gram[np.ix_(support, support)]
            w = np.linalg.lstsq(np.block([[g, np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]]), np.append(np.zeros(size), 1.0), rcond=None)[0][:size]
            if (w >= -1e-12).all():
                whole = np.zeros(len(gram))
                whole[list(support)] = np.maximum(w, 0)
                found.append((w @ g @ w, whole / whole.sum()))
    least = min(value for value, _ in found)
    return next(w for value, w in found if value <= least + 1e-9)


def _gram(df: DataFrame, models: list[str], *by: str) -> DataFrame:
    """By key, n and the mean products of the errors of all pairs of models; rows that lack the target or a model are left out."""
    errors = [F.log1p("target") - F.col(m) for m in models]
    return df.dropna(subset=["target", *models]).groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.avg(a * b) for a in errors for b in errors]).alias("gram"))


def simplex_weights(df: DataFrame, models: list[str]) -> dict[str, float]:
    """Non-negative weights that sum to 1 with the least squared error to log1p(target): an exact quadratic program.

    One aggregation gives the Gram matrix of the errors; its size is the number of models, so the driver tries the supports.
    Without rows all models weigh the same.
    """
    row = _gram(df, models).first()
    k = len(models)
    found = _simplex(np.array(row["gram"]).reshape(k, k)) if row["n"] else np.full(k, 1 / k)
    return {m: float(w) for m, w in zip(models, found, strict=True)}


def segment_weights(df: DataFrame, models: list[str], by: str = "segment", least: int = 200) -> DataFrame:
    """by, n and a weight_ column for each model: the best convex blend in log space within each segment; a null segment is one too.

    Segments with fewer than least rows take the weights over all rows. Rows meet as one Gram matrix by segment, from partial
    sums; each is solved where it lies, so there may be many segments.
    """
    k, names = len(models), [f"weight_{m}" for m in models]
    overall = list(simplex_weights(df, models).values())

    def solve(batches):
        for b in batches:
            w = [_simplex(np.reshape(g, (k, k))) if n >= least else overall for g, n in zip(b["gram"], b["n"], strict=True)]
            yield b[[by, "n"]].join(pd.DataFrame(np.reshape(w, (len(b), k)), columns=names, index=b.index))

    schema = StructType([df.schema[by], StructField("n", LongType()), *[StructField(n, DoubleType()) for n in names]])
    return _gram(df, models, by).mapInPandas(solve, schema)


def segment_blend(df: DataFrame, weights: DataFrame, overall: dict[str, float], by: str = "segment", name: str = "blend_log") -> DataFrame:
    """df with the log prediction that the weights of its row's segment give; rows of a segment without weights take the overall ones."""
    known = weights.select(F.col(by).alias("_segment"), F.struct(*[f"weight_{m}" for m in overall]).alias("_weights"))
    met = df.join(known, df[by].eqNullSafe(known["_segment"]), "left")
    blend = sum((F.col(m) * F.coalesce(F.col(f"_weights.weight_{m}"), F.lit(w)) for m, w in overall.items()), F.lit(0.0))
    return met.withColumn(name, blend).drop("_segment", "_weights")


def log_blend(df: DataFrame, specs: dict[str, dict[str, float]], scale: float = 1.0) -> DataFrame:
    """user_id and a prediction for each spec: expm1 of the weighted sum of logs, kept between 0 and 20."""
    logs = lambda m: F.log1p(F.greatest(F.lit(0.0), F.col(m)))
    blended = {name: sum((logs(m) * w for m, w in spec.items()), F.lit(0.0)) * scale for name, spec in specs.items()}
    return df.select("user_id", *[F.expm1(F.greatest(F.lit(0.0), F.least(F.lit(20.0), x))).alias(name) for name, x in blended.items()])


def extrapolated(at_zero: Column, at_known: Column, alpha: float, known: float = 0.05) -> Column:
    """The log prediction at another alpha, along the line through those at 0 and at a known one."""
    return at_zero + F.lit(alpha / known) * (at_known - at_zero)


#: Alphas that are tried along the line, and small changes of the scale of logs.
LINE_ALPHAS = (0.015, 0.025, 0.035, 0.04, 0.045, 0.055, 0.065, 0.075)
LOG_SCALES = (0.99, 0.995, 1.0025, 1.005, 1.01)


def line_and_scale(df: DataFrame, at_zero: str, at_known: str, known: float = 0.05) -> DataFrame:
    """user_id and a prediction for each of LINE_ALPHAS and of LOG_SCALES, from logs at alpha 0 and at a known one; logs are kept between 0 and 20."""
    value = lambda log: F.expm1(F.greatest(F.lit(0.0), F.least(F.lit(20.0), log)))
    name = lambda kind, x: f"{kind}_{x:.4f}".replace(".", "_")
    line = [value(extrapolated(F.col(at_zero), F.col(at_known), a, known)).alias(name("alpha", a)) for a in LINE_ALPHAS]
    return df.select("user_id", *line, *[value(F.col(at_known) * F.lit(x)).alias(name("scale", x)) for x in LOG_SCALES])


def prediction_stats(df: DataFrame, base: str, models: list[str]) -> DataFrame:
    """model, corr_log (with the base's logs), mean, median, p95 and max of each model's predictions."""
    log = lambda m: F.log1p(F.greatest(F.lit(0.0), F.col(m)))
    long = df.select(log(base).alias("base"), F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("v")) for m in models])).alias("x"))
    sums = long.groupBy("x.model").agg(F.corr("base", F.log1p(F.greatest(F.lit(0.0), F.col("x.v")))).alias("corr_log"), F.avg("x.v").alias("mean_pred"), F.max("x.v").alias("max_pred"))
    middle = exact_quantiles(long.select("x.model", "x.v"), {m: [0.5, 0.95] for m in models}, "model", "v")
    found = df.sparkSession.createDataFrame([(m, *map(lambda q: None if q is None else float(q), qs)) for m, qs in middle.items()], "model string, median_pred double, p95_pred double")
    return sums.join(F.broadcast(found), "model").select("model", "corr_log", "mean_pred", "median_pred", "p95_pred", "max_pred")


def linear_calibration(df: DataFrame, log_column: str) -> DataFrame:
    """slope and bias of log1p(target) on the log prediction; the calibrated one is max(slope * log + bias, 0)."""
    return df.agg(F.regr_slope(F.log1p("target"), F.col(log_column)).alias("slope"), F.regr_intercept(F.log1p("target"), F.col(log_column)).alias("bias"))


def recency_segment(days: Column, never: Column) -> Column:
    return F.when(never == 1, "never").when(days <= 7, "0_7").when(days <= 30, "8_30").when(days <= 90, "31_90").otherwise("91_plus")


def segment_scores(df: DataFrame, log_column: str) -> DataFrame:
    return df.groupBy("segment").agg(F.count("*").alias("n"), rmsle(F.col("target"), F.col(log_column)).alias("rmsle"))


def expanding_folds(snapshots: list[str], first: int = 2) -> list[tuple[int, list[str], str]]:
    """fold, the snapshots to train on and the one to validate on, for each snapshot from the first valid one on."""
    return [(i - first + 1, snapshots[:i], snapshots[i]) for i in range(first, len(snapshots))]


def fold_rows(df: DataFrame, snapshots: list[str], first: int = 2, weights: dict[str, float] | None = None) -> DataFrame:
    """df's rows once per fold that they take part in, with fold, role (train or valid) and sample_weight."""
    roles = [F.struct(F.lit(k).alias("fold"), F.when(F.col("snapshot_name") == valid, "valid").when(F.col("snapshot_name").isin(*train), "train").alias("role")) for k, train, valid in expanding_folds(snapshots, first)]
    out = df.drop("fold", "role").select("*", F.explode(F.array(*roles)).alias("f")).where("f.role is not null").select("*", "f.fold", "f.role").drop("f")
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("snapshot_name") == name, F.lit(w)).otherwise(weight)
    return out.withColumn("sample_weight", weight)


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean, median, deviation and worst of the folds' rmsle."""
    return scores.agg(F.avg("rmsle").alias("mean"), F.percentile("rmsle", 0.5).alias("median"), F.coalesce(F.stddev_samp("rmsle"), F.lit(0.0)).alias("std"), F.max("rmsle").alias("worst"))
