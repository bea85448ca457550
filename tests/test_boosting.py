"""Boosting against brute force over all splits, and its independence of partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as B

NAMES = [f"f{i}" for i in range(5)]


def table(n=500, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 2)
    x[:, 3] = rng.integers(0, 4, n)
    x[rng.random(n) < 0.1, 1] = np.nan
    y = np.where(x[:, 0] > 0.3, 2.0, 0.0) + 0.5 * x[:, 3] + np.where(np.isnan(x[:, 1]), -1, 0) + 0.1 * rng.normal(size=n)
    return x, np.round(y, 3), np.round(rng.random(n) + 0.5, 2)


def frame(spark, x, y, w, valid=None):
    rows = [(i, *map(float, r), float(t), float(s), bool(valid is not None and valid[i])) for i, (r, t, s) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, f"user_id long, {', '.join(f'{n} double' for n in NAMES)}, target double, w double, valid boolean")


def brute_split(x, g, h, cuts, l2):
    """The best (gain, feature, bin) of a node by trying every split with masks."""
    best = (-np.inf, 0, 0)
    bins = B.binned(x, cuts)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    every = np.ones(len(x), bool)
    for f in range(x.shape[1]):
        for cut in range(int(bins[:, f].max())):
            left = bins[:, f] <= cut
            if left.any() and (~left).any():
                gain = score(left) + score(~left) - score(every)
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    return best


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_first_splits_equal_brute_force(spark, loss):
    x, y, w = table()
    y = (y > 1).astype(float) if loss == "logistic" else y
    model = B.fit(frame(spark, x, y, w), NAMES, weight="w", options=B.Options(loss=loss, trees=1, depth=2, grow="leaf", leaves=3, bins=32))
    _, g, h = B.derivatives(loss, y, np.full(len(y), model.start))
    gain, f, cut = brute_split(x, g * w, h * w, model.cuts, 1.0)
    tree = model.trees[0]
    assert (tree.feature[0], tree.bin[0]) == (f, cut)
    left = B.binned(x, model.cuts)[:, f] <= cut
    offers = {n: brute_split(x[m], (g * w)[m], (h * w)[m], model.cuts, 1.0) for n, m in ((1, left), (2, ~left))}
    chosen = max(offers, key=lambda n: offers[n][0])
    assert (tree.feature[chosen], tree.bin[chosen]) == offers[chosen][1:]
    assert tree.value[3 - chosen] == pytest.approx(-(g * w)[left if chosen == 2 else ~left].sum() / ((h * w)[left if chosen == 2 else ~left].sum() + 1.0), abs=1e-4)
    assert model.gains.sum() == pytest.approx(gain + offers[chosen][0], rel=1e-3)


def test_symmetric_split_is_the_best_for_all_nodes_of_a_level(spark):
    x, y, w = table(300, 2)
    model = B.fit(frame(spark, x, y, w), NAMES, options=B.Options(trees=1, depth=2, bins=16))
    tree, bins, g = model.trees[0], B.binned(x, model.cuts), model.start - y
    first = bins[:, tree.feature[0]] <= tree.bin[0]
    assert (tree.feature[1], tree.bin[1]) == (tree.feature[2], tree.bin[2]), "one split a level"
    score = lambda m: g[m].sum() ** 2 / (m.sum() + 1.0)
    total = {(f, c): sum(score(m & (bins[:, f] <= c)) + score(m & (bins[:, f] > c)) - score(m) for m in (first, ~first) if (m & (bins[:, f] <= c)).any() and (m & (bins[:, f] > c)).any()) for f in range(5) for c in range(17)}
    assert total[tree.feature[1], tree.bin[1]] == pytest.approx(max(total.values()), abs=1e-3)


def test_models_do_not_depend_on_partitions_and_only_histograms_reach_the_driver(spark):
    x, y, w = table(800, 1)
    o = B.Options(trees=10, depth=3, bins=16)
    one, other = (B.fit(frame(spark, x, y, w).repartition(p), NAMES, weight="w", options=o) for p in (1, 7))
    assert [t.__dict__ for t in one.trees] == [t.__dict__ for t in other.trees] and one.losses == other.losses
    assert one.most_cells <= 2 ** (o.depth - 1) * 5 * o.bins * 3
    losses = [t for t, _ in one.losses]
    assert len(losses) == 11 and all(b < a for a, b in zip(losses, losses[1:], strict=False))
    bins = B.binned(x, one.cuts)
    margin = one.start + sum(o.rate * t.values(bins) for t in one.trees)
    got = [r.prediction for r in one.predict(frame(spark, x, y, w)).orderBy("user_id").collect()]
    assert got == pytest.approx(margin.tolist())
    assert one.importance()[0][0] == "f0"


def test_boosting_stops_once_validation_gets_no_better(spark):
    x, y, w = table(300, 4)
    noise = np.random.default_rng(5).normal(size=300)
    valid = np.arange(300) % 3 == 0
    model = B.fit(frame(spark, x, np.where(valid, y, noise), w, valid), NAMES, valid="valid", options=B.Options(trees=30, depth=3, bins=16, rate=0.5, patience=3))
    valid_losses = [v for _, v in model.losses]
    assert len(model.trees) < 30 and model.best == int(np.argmin(valid_losses)) and len(valid_losses) - 1 - model.best == 3


def test_odd_rows(spark):
    x, y, w = table(50)
    x[:, 2] = np.nan
    rows = frame(spark, x, y, w).withColumn("target", F.when(F.col("user_id") == 0, F.lit(None)).otherwise(F.col("target")))
    model = B.fit(rows.withColumn("PREDICTION", F.lit("x")), NAMES, options=B.Options(trees=2, depth=2, bins=8, grow="leaf"))
    assert model.importance()[-1][1] == 0 and model.predict(rows).count() == 50
    assert model.predict(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        B.fit(rows.limit(0), NAMES)
    same = B.fit(rows.withColumn("target", F.lit(2.5)), NAMES, options=B.Options(trees=2))
    assert {r.prediction for r in same.predict(rows).collect()} == {2.5}


def test_categories_never_see_their_own_target(spark):
    rows = [(i, "a" if i < 6 else "b" if i < 9 else None, float(i), i != 8) for i in range(10)]
    df = spark.createDataFrame(rows, "user_id long, kind string, target double, learn boolean")
    before = {r.user_id: r.kind_mean for r in B.encoded_categories(df, "kind", "target", "learn", folds=64).collect()}
    changed = df.withColumn("target", F.when(F.col("user_id") == 8, F.lit(99.0)).otherwise(F.col("target")))
    after = {r.user_id: r.kind_mean for r in B.encoded_categories(changed, "kind", "target", "learn", folds=64).collect()}
    assert before == after, "targets of rows that are not learned from change nothing"
    mean = np.mean([i for i in range(10) if i != 8])
    assert before[8] == pytest.approx((6 + 7 + 10 * mean) / 12) and before[9] == pytest.approx(mean)
