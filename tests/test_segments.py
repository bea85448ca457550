"""Blends by segment against a fine grid of weights, and a fit of spend that doesn't depend on the unit of money."""

import random

import numpy as np
import pytest

from tidemark.operators import btyd
from tidemark.operators import evaluation as E

MODELS = ["a", "b", "c"]
SCHEMA = "segment string, target double, a double, b double, c double, n int"


def rows(segments, count, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for k, s in enumerate(segments):
        for _ in range(count):
            t = float(rng.gamma(2.0, 3.0))
            noise = rng.normal(size=3) * (0.2 + np.roll([0.1, 0.5, 0.9], k))
            out.append((s, t, *(float(np.log1p(t) + e) for e in noise), 1))
    return out


def error(data, w):
    x = np.array([[np.log1p(r[1]) - r[2 + k] for k in range(3)] for r in data])
    return float(((x @ w) ** 2).mean())


def test_weights_of_each_segment(spark):
    data = rows(["x", "y", None], 120) + rows(["few"], 5)
    data += [("x", None, 1.0, 1.0, 1.0, 1), ("y", 2.0, None, 1.0, 1.0, 1)]  # neither is learned from
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    weights = E.segment_weights(df.drop("n"), MODELS, least=50)
    got = {r.segment: r for r in weights.collect()}
    overall = E.simplex_weights(df, MODELS)
    assert {s: r.n for s, r in got.items()} == {"x": 120, "y": 120, None: 120, "few": 5}
    grid = [(i / 40, j / 40, 1 - (i + j) / 40) for i in range(41) for j in range(41 - i)]
    for s, r in got.items():
        w = np.array(r[2:])
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        own = [x for x in data if x[0] == s and None not in x[1:]]
        if s == "few":
            assert w.tolist() == pytest.approx(list(overall.values()))
        else:
            best = min(error(own, np.array(g)) for g in grid)
            assert best - 2e-3 <= error(own, w) <= best + 1e-12
    other = spark.createDataFrame([("x", 1.0, 1.0, 2.0, 3.0, 7), (None, 1.0, 1.0, 2.0, 3.0, 8), ("unseen", 1.0, 1.0, 2.0, 3.0, 9)], SCHEMA)
    blended = {r.n: r.blend_log for r in E.segment_blend(other, weights, overall).collect()}
    for n, w in ((7, got["x"][2:]), (8, got[None][2:]), (9, list(overall.values()))):
        assert blended[n] == pytest.approx(np.dot(w, [1, 2, 3]))


def test_equal_models_and_no_rows(spark):
    same = spark.createDataFrame([("s", float(t), 0.5, 0.5, 0.7, 1) for t in range(9)], SCHEMA)
    assert E.simplex_weights(same, ["a", "b"]) == {"a": 1.0, "b": 0.0}
    assert E.simplex_weights(same.limit(0), MODELS) == pytest.approx(dict.fromkeys(MODELS, 1 / 3))
    assert E.segment_weights(same.limit(0).drop("n"), MODELS).count() == 0


def test_spend_in_any_unit(spark):
    rng = random.Random(4)
    data = [(rng.choice([0, 1, 2, 3, 5]), rng.gammavariate(3.0, 20.0)) for _ in range(400)]
    fit = lambda unit: btyd.fit_gamma_gamma(spark.createDataFrame([(x, m * unit) for x, m in data], "frequency long, monetary_value double"))
    (p, q, v), small = fit(1.0), fit(1e-3)
    assert small[:2] == pytest.approx((p, q), rel=1e-3) and small[2] == pytest.approx(v * 1e-3, rel=1e-3)
