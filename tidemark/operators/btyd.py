"""Buy till you die: repeat-purchase summaries, BG/NBD and Gamma-Gamma.

The models' likelihoods depend on a user's summary alone, so users are counted by distinct summary first and the fit runs
over those counts. The published formulas: Fader, Hardie and Lee 2005 (BG/NBD); Fader and Hardie 2013 (Gamma-Gamma).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of counts that the driver fits on at most. More stay in Spark, which adds up the likelihood of all for each step.
MOST_SUMMARIES = 200_000


def summary(panel: DataFrame, cutoff: str) -> DataFrame:
    """user_id, frequency (repeat days), recency, T and monetary_value over the whole history; zeros without a purchase."""
    day = F.lit(cutoff).cast("date")
    bought = panel.where((F.col("event_date") <= day) & (F.col("gmv") > 0))
    own = bought.groupBy("user_id").agg(F.min("event_date").alias("a"), F.max("event_date").alias("b"), F.count_distinct("event_date").alias("n"), F.avg("gmv").alias("monetary_value"))
    own = own.select("user_id", (F.col("n") - 1).alias("frequency"), F.datediff("b", "a").alias("recency"), F.datediff(day, F.col("a")).alias("T"), "monetary_value")
    return panel.select("user_id").distinct().join(own, "user_id", "left").fillna(0)


_LGAMMA = np.frompyfunc(math.lgamma, 1, 1)


def _lgamma(x):
    return _LGAMMA(np.asarray(x, float)).astype(float)


def _bgnbd_each(theta: np.ndarray, x: np.ndarray, tx: np.ndarray, t: np.ndarray) -> np.ndarray:
    r, alpha, a, b = np.exp(theta)
    one = _lgamma(r + x) - math.lgamma(r) + r * np.log(alpha)
    two = math.lgamma(a + b) + _lgamma(b + x) - math.lgamma(b) - _lgamma(a + b + x)
    three = -(r + x) * np.log(alpha + t)
    four = np.where(x > 0, np.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + tx), -np.inf)
    return one + two + np.logaddexp(three, four)


def bgnbd_loglik(theta: np.ndarray, x: np.ndarray, tx: np.ndarray, t: np.ndarray, n: np.ndarray, penalty: float = 0.01) -> float:
    return float((_bgnbd_each(theta, x, tx, t) * n).sum() / n.sum() - penalty * (np.exp(theta) ** 2).sum())


def _gamma_gamma_each(theta: np.ndarray, x: np.ndarray, m: np.ndarray) -> np.ndarray:
    p, q, v = np.exp(theta)
    return _lgamma(p * x + q) - _lgamma(p * x) - math.lgamma(q) + q * np.log(v) + (p * x - 1) * np.log(m) + p * x * np.log(x) - (p * x + q) * np.log(x * m + v)


def gamma_gamma_loglik(theta: np.ndarray, x: np.ndarray, m: np.ndarray, n: np.ndarray, penalty: float = 0.01) -> float:
    return float((_gamma_gamma_each(theta, x, m) * n).sum() / n.sum() - penalty * (np.exp(theta) ** 2).sum())


def _scores(counts: DataFrame, columns: tuple[str, ...], each, penalty: float):
    """A function from points to their mean log-likelihoods over all of counts (columns and n), less the penalty."""
    counts = counts.select(*[F.col(c).cast("double") for c in (*columns, "n")])
    some = counts.limit(MOST_SUMMARIES + 1).toPandas()
    if len(some) <= MOST_SUMMARIES:
        x, n = [some[c].to_numpy(float) for c in columns], some["n"].to_numpy(float)
        return lambda points: [float((each(p, *x) * n).sum() / n.sum() - penalty * (np.exp(p) ** 2).sum()) for p in points]
    everyone = counts.agg(F.sum("n")).first()[0]

    def scores(points: list[np.ndarray]) -> list[float]:
        def add(batches):
            sums = np.zeros(len(points))
            for b in batches:
                x, n = [b[c].to_numpy(float) for c in columns], b["n"].to_numpy(float)
                sums += [(each(p, *x) * n).sum() for p in points]
            yield pd.DataFrame({"point": range(len(points)), "s": sums})

        sums = dict(counts.mapInPandas(add, "point int, s double").groupBy("point").agg(F.sum("s")).collect())
        return [sums[i] / everyone - penalty * float((np.exp(p) ** 2).sum()) for i, p in enumerate(points)]

    return scores


def _climb(scores, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Nelder and Mead's simplex search for the largest score; the trial points of a round are scored at once."""
    size = len(start)
    points = [start] + [start + 0.5 * np.eye(size)[i] for i in range(size)]
    values = scores(points)
    for _ in range(rounds):
        order = np.argsort(values)[::-1]
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[0] - values[-1]) < 1e-10:
            break
        centre = np.mean(points[:-1], axis=0)
        trials = [(step, centre + step * (centre - points[-1])) for step in (1.0, 2.0, -0.5)]
        for (step, trial), value in zip(trials, scores([t for _, t in trials]), strict=True):
            if step == 2.0 and not better:  # noqa: F821
                continue
            better = value > values[0]
            if value > values[-1]:
                points[-1], values[-1] = trial, value
                if not better or step == 2.0:
                    break
            elif step == 2.0:
                break
        else:
            points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
            values = [values[0]] + scores(points[1:])
    return points[int(np.argmax(values))]


def fit_bgnbd(rows: DataFrame, penalty: float = 0.01) -> tuple[float, float, float, float]:
    """r, alpha, a, b. rows: frequency, recency, T."""
    counts = rows.groupBy("frequency", "recency", "T").agg(F.count("*").alias("n")).persist()
    unit = max(1.0, counts.agg(F.max("T")).first()[0] / 10)  # time in tenths of the longest age, so that the search starts well
    scaled = counts.select("frequency", (F.col("recency") / unit).alias("recency"), (F.col("T") / unit).alias("T"), "n")
    r, alpha, a, b = np.exp(_climb(_scores(scaled, ("frequency", "recency", "T"), _bgnbd_each, penalty), np.zeros(4)))
    counts.unpersist()
    return float(r), float(alpha * unit), float(a), float(b)


def fit_gamma_gamma(rows: DataFrame, penalty: float = 0.01) -> tuple[float, float, float]:
    """p, q, v. rows: frequency, monetary_value; those of users with repeat purchases count, with their money as it is, in whatever unit."""
    own = rows.where("frequency > 0 and monetary_value > 0").groupBy("frequency", F.col("monetary_value").alias("m")).agg(F.count("*").alias("n")).persist()
    unit = float(own.agg(F.sum(F.col("m") * F.col("n")) / F.sum("n")).first()[0])
    p, q, v = np.exp(_climb(_scores(own.select("frequency", (F.col("m") / unit).alias("m"), "n"), ("frequency", "m"), _gamma_gamma_each, penalty), np.zeros(3)))
    own.unpersist()
    return float(p), float(q), float(v * unit)


def _hyper(a, b, c, z, terms: int = 600):
    """Gauss's series 2F1(a, b; c; z) for 0 <= z < 1."""
    out, term = np.ones_like(z), np.ones_like(z)
    for k in range(terms):
        term = term * (a + k) * (b + k) / (c + k) / (k + 1) * z
        out = out + term
        if np.all(np.abs(term) < 1e-12 * np.abs(out)):
            break
    return out


def expected_purchases(rows: DataFrame, model: tuple[float, float, float, float], days: int = 30) -> DataFrame:
    """rows with expected_purchases in so many days, by the conditional expectation of BG/NBD."""
    r, alpha, a, b = model

    @F.pandas_udf("double")
    def expect(x: pd.Series, tx: pd.Series, t: pd.Series) -> pd.Series:
        x, tx, t = (v.to_numpy(float) for v in (x, tx, t))
        z = days / (alpha + t + days)
        share = ((alpha + t) / (alpha + t + days)) ** (r + x) * _hyper(r + x, b + x, a + b + x - 1, z)
        top = (a + b + x - 1) / (a - 1) * (1 - share)
        dead = np.where(x > 0, a / (b + np.maximum(x, 1) - 1) * ((alpha + t) / (alpha + tx)) ** (r + x), 0)
        return pd.Series(np.maximum(top / (1 + dead), 0))

    return rows.withColumn("expected_purchases", expect(F.col("frequency").cast("double"), F.col("recency").cast("double"), F.col("T").cast("double")))


def expected_spend(rows: DataFrame, model: tuple[float, float, float]) -> DataFrame:
    """rows with expected_spend: a weighted mean of the user's and the population's; the mean for users without repeats."""
    p, q, v = model
    x, m = F.col("frequency").cast("double"), F.col("monetary_value")
    known = p * (v + x * m) / (p * x + q - 1)
    mean = p * v / (q - 1) if q > 1 else 0.0
    return rows.withColumn("expected_spend", F.when((x > 0) & (m > 0), known).otherwise(F.when(m > 0, m).otherwise(F.lit(mean))))


def forecast(panel: DataFrame, cutoff: str, days: int = 30) -> DataFrame:
    """user_id and predict: expected purchases times expected spend, not below 0 and finite."""
    rows = summary(panel, cutoff)
    both = expected_spend(expected_purchases(rows, fit_bgnbd(rows), days), fit_gamma_gamma(rows))
    value = F.col("expected_purchases") * F.col("expected_spend")
    return both.withColumn("predict", F.when(F.isnan(value) | value.isNull() | (value == float("inf")), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), value)))
