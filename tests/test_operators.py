"""Sequences, grids, stacking, guards, repeat purchases, tables and streams."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators import btyd, guards, models, stacking
from tidemark.operators import evaluation as E
from tidemark.operators import sequence as S
from tidemark.plans.config import SequenceConfig
from tidemark.sources import tables
from tidemark.sources.panel import PANEL, events_panel
from tidemark.streaming import daily

CUTOFF = dt.date(2025, 8, 17)
C = SequenceConfig(CUTOFF.isoformat())


def row(user, day_index, gmv=0.0, searches=0):
    base = {f.name: 0.0 if f.name.startswith("gmv") else 0 for f in PANEL} | {"user_id": user, "event_date": CUTOFF - dt.timedelta(days=179 - day_index), "gmv": gmv, "searches": searches}
    return tuple(base[f.name] for f in PANEL)


def test_sequence_frames_count_calendar_days(spark):
    panel = spark.createDataFrame([row(1, 0, 2.0), row(1, 1, 4.0), row(1, 7, 8.0), row(1, 8, 16.0), row(2, 185, 3.0)], PANEL)
    out = S.sequence_features(panel, C)
    got = {(r.user_id, r.day_index): r for r in out.collect()}
    assert [got[1, d].roll_gmv_sum_7d for d in (0, 1, 7, 8)] == [2, 6, 12, 24]
    assert [got[1, d].lag_gmv_7d for d in (0, 1, 7, 8)] == [0, 0, 2, 4]
    assert got[1, 179].cutoff_state_row == 1 and got[1, 179].days_since_gmv == 171 and got[1, 8].days_since_prev_observed == 1
    assert got[2, -1].roll_gmv_sum_7d == 0 and got[2, 179].days_since_gmv == 181 and got[2, 179].never_gmv == 1 and got[2, 179].target == 3
    keep = 0.5 ** (1 / 7)
    assert got[1, 1].ewm_gmv_halflife_7d == pytest.approx((1 - keep) * (4 + 2 * keep))
    assert sum(len(S.family_texts(f, C)) for f in S.FAMILIES) + 1 == 104
    tensor = {r.user_id: r.tensor for r in S.dense(out, ["gmv", "searches"], C).collect()}
    assert len(tensor[1]) == 180 and tensor[1][7] == [8.0, 0.0] and tensor[2][5] == [0.0, 0.0]


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (3.0, 2.0)], "a double, b double")
    got = df.select(expr.safe_ratio(F.col("a"), F.col("b")).alias("r"), F.expr(expr.ratio("a", "b")).alias("t"), expr.clipped(F.col("a"), 0, 2).alias("c"), expr.finite(F.col("a") / F.lit(2)).alias("f")).collect()
    assert [(r.r, r.t, r.c, r.f) for r in got] == [(0, 0, 1, 0.5), (0, 0, None, 0), (1.5, 1.5, 2, 1.5)]
    p = spark.range(1).select(expr.sigmoid(expr.logit(F.lit(0.3))).alias("p")).first().p
    assert p == pytest.approx(0.3)


def predictions(spark, n=300):
    rng = np.random.default_rng(2)
    rows = [(int(i), f"s{i % 3}", float(max(0, rng.normal(1, 2))), float(rng.uniform(0.01, 0.99)), float(rng.uniform(0, 5)), int(i % 2), float(rng.normal(0, 0.3))) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, snapshot_name string, target double, probability double, positive_prediction double, fold int, residual_prediction double").withColumn("positive", (F.col("target") > 0).cast("int"))


def test_grids_against_numpy(spark):
    p = predictions(spark)
    x = p.toPandas()
    t = np.log1p(x.target)
    got = {(r.gamma, r.scale): r for r in E.gamma_scale_grid(p).collect()}
    assert len(got) == 16 * 9
    for g, s in ((1.0, 0.96), (1.15, 1.04)):
        q = x.probability**g * s * np.log1p(x.positive_prediction)
        own = [math.sqrt(((t - q)[x.snapshot_name == n] ** 2).mean()) for n in ("s0", "s1", "s2")]
        assert got[g, s].rmsle == pytest.approx(math.sqrt(((t - q) ** 2).mean()))
        assert got[g, s].stable_score == pytest.approx(got[g, s].rmsle + 0.25 * np.std(own, ddof=1))
    hurdle = E.residuals(E.hurdle_combine(p))
    grid = E.alpha_grid(hurdle)
    base = x.probability * np.log1p(x.positive_prediction)
    rows = {(r.alpha, r.fold): r.rmsle for r in grid.collect()}
    assert rows[0.1, None] == pytest.approx(math.sqrt(((t - np.maximum(base + 0.1 * x.residual_prediction, 0)) ** 2).mean()))
    assert E.chosen_alpha(grid, 10.0) == 0.0
    assert E.auc(p, "positive", "probability").first().auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in x.probability[x.positive == 1] for b in x.probability[x.positive == 0]]))
    best = E.simplex_weights(p.withColumn("a", F.log1p("positive_prediction")).withColumn("b", F.lit(0.5)).withColumn("c", F.lit(0.0)), ["a", "b", "c"])
    assert sum(best.values()) == pytest.approx(1) and min(best.values()) >= 0
    errors = lambda w: ((t - w[0] * np.log1p(x.positive_prediction) - w[1] * 0.5) ** 2).mean()
    tried = min(errors((i / 50, j / 50)) for i in range(51) for j in range(51 - i))
    assert errors((best["a"], best["b"])) <= tried + 1e-9


def test_folds(spark):
    assert E.expanding_folds(["a", "b", "c", "d"]) == [(1, ["a", "b"], "c"), (2, ["a", "b", "c"], "d")]
    rows = E.fold_rows(predictions(spark), ["s0", "s1", "s2"], 1, {"s0": 2.0})
    assert rows.where("fold = 1").select("snapshot_name", "role").distinct().count() == 2
    assert rows.where("fold = 2 and role = 'train'").agg(F.sum("sample_weight")).first()[0] == 300


def test_stacking_and_guards(spark):
    p = predictions(spark)
    head = p.select("user_id", "snapshot_name", "target")
    half = p.where("user_id < 150").select("user_id", "snapshot_name", "target", F.col("positive_prediction").alias("predict"))
    out = stacking.stack(head, {"b": (half, "predict"), "a": (half, "predict")})
    assert out.columns == ["user_id", "snapshot_name", "target", "a", "b"] and out.count() == 150
    with pytest.raises(ValueError, match="differ"):
        stacking.merge_oof(head, half.withColumn("target", F.col("target") + 1), "x", "predict")
    with pytest.raises(ValueError, match="repeat"):
        stacking.merge_oof(head, half.union(half), "x", "predict")
    with pytest.raises(ValueError, match="missing"):
        guards.require_columns(head, ["nothing"])
    with pytest.raises(ValueError, match="empty"):
        guards.require_rows(head.limit(0), "head")
    guards.require_predictions(half, "predict", 150)
    with pytest.raises(ValueError, match="bad"):
        guards.require_predictions(half.withColumn("predict", F.lit(-1.0)), "predict")
    assert stacking.prediction_column(half) == "predict"
    assert stacking.pick_features(p, ["fold", "absent"], ["prob"], 3) == ["fold", "probability", "positive_prediction"]


def test_btyd(spark):
    rng = np.random.default_rng(0)
    rows = []
    for u in range(400):  # buyers at rates from a gamma distribution, who drop out with some chance after a purchase
        rate, drop = rng.gamma(1.0, 1 / 20), rng.beta(1, 4)
        day = int(rng.integers(0, 100))
        while day < 300:
            rows.append((u, dt.date(2024, 1, 1) + dt.timedelta(days=day), float(rng.gamma(5, 4))))
            if rng.random() < drop:
                break
            day += max(1, int(rng.exponential(1 / rate)))
    panel = spark.createDataFrame(rows, "user_id long, event_date date, gmv double").groupBy("user_id", "event_date").agg(F.sum("gmv").alias("gmv"))
    out = btyd.forecast(panel, "2024-10-26").toPandas()
    assert (out.predict >= 0).all() and len(out) == 400
    assert out[out.frequency > 5].expected_purchases.mean() > out[out.frequency == 0].expected_purchases.mean()
    assert 10 < out[out.frequency > 0].expected_spend.mean() < 40


def test_models_learn(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, 900)
    rows = [(i, f"s{i % 3}", float(v), float(math.expm1(3 * v) if v > 0.5 else 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "user_id long, snapshot_name string, x double, target double")
    out = models.backtest(df, ["x"], ["s0", "s1", "s2"], trees=5, depth=3)
    assert out.where("snapshot_name = 's2'").count() == 300
    assert out.agg(E.rmsle(F.col("target"), F.col("pred_log")).alias("e")).first().e < 0.3


def test_fold_scores_and_acceptance(spark):
    p = predictions(spark).withColumns({"probability": F.round("probability", 1), "pred_log": F.log1p("positive_prediction")})
    lone = p.where("target > 0").limit(5).withColumn("fold", F.lit(9))
    got = {r.fold: r for r in models.fold_scores(p.unionByName(lone)).collect()}
    assert got[9].auc is None and set(got) == {0, 1, 9}
    for fold in (0, 1):
        one = p.where(F.col("fold") == fold)
        assert got[fold].auc == pytest.approx(E.auc(one, "positive", "probability").first().auc)
        x = one.toPandas()
        assert got[fold].rmsle == pytest.approx(math.sqrt(((np.log1p(x.target) - x.pred_log) ** 2).mean()))
    scores = models.fold_scores(p)
    mean = (got[0].rmsle + got[1].rmsle) / 2
    assert models.accepted(scores, mean + 0.002) == pytest.approx(mean)
    assert models.accepted(scores, mean + 0.0005) is None and models.accepted(scores.limit(0), 1.0) is None


def test_feature_sweep(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(math.expm1(3 * a) if a > 0.5 else 0)) for a, b in rng.uniform(0, 1, (300, 2))]
    df = spark.createDataFrame(rows, "x double, noise double, target double")
    found = models.top_feature_sweep(df, df, ["x", "noise"], (1, 2, 45), trees=3, depth=2)
    assert sorted(n for n, _ in found) == [1, 2] and found[0][1] <= found[1][1] < 0.6


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2025, 1, 1), 2.0), (2, dt.date(2025, 1, 8), 3.0)], "user_id long, cutoff_date date, x double")
    tables.write_snapshot(df, f"{tmp_path}/snap")
    tables.write_snapshot(df.where("user_id = 2").withColumn("x", F.lit(9.0)), f"{tmp_path}/snap")
    back = tables.read_snapshots(spark, [f"{tmp_path}/snap"], {"2025-01-01": 0.5})
    assert sorted((r.user_id, r.x, r.sample_weight) for r in back.collect()) == [(1, 2.0, 0.5), (2, 9.0, 1.0)]
    assert tables.feature_columns(back) == ["x", "cutoff_date", "sample_weight"]
    tables.write_csv(df.select("user_id", (F.col("x") - 5).alias("prediction")), f"{tmp_path}/csv")
    assert sorted(r.predict for r in tables.read_submission(spark, f"{tmp_path}/csv").collect()) == [0.0, 0.0]
    assert list(tables.existing(spark, {"a": f"{tmp_path}/csv", "b": f"{tmp_path}/nothing"})) == ["a"]
    tables.write_summary(spark, f"{tmp_path}/json", {"a": 1})
    assert spark.read.json(f"{tmp_path}/json").first().a == 1


def test_streams(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1 + i // 4, i % 24), i % 2, ["view", "purchase"][i % 2], 5.0, '{"k": 1}') for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events")

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/state-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    source = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    days = run(daily.daily_stream(source), "days")
    batch = events_panel(events).select("user_id", "event_date", "gmv")
    assert days.count() > 0 and days.select("user_id", "event_date", "gmv").subtract(batch).isEmpty()
    days.write.parquet(f"{tmp_path}/days")
    stream = spark.readStream.schema(days.schema).parquet(f"{tmp_path}/days")
    out = run(daily.decayed_stream(stream, 1.0), "decayed").orderBy("user_id", "event_date").collect()
    own = [r.decay_gmv for r in out if r.user_id == 1]
    assert own[0] == 10 and own[1] == pytest.approx(15)


def test_final_submission_needs_the_same_users(spark):
    table = lambda column, rows: spark.createDataFrame(rows, f"user_id long, {column} double")
    classifier, regressor = table("probability", [(1, 0.5), (2, 1.0)]), table("positive_prediction", [(2, 3.0), (1, 0.0)])
    residual = table("residual_prediction", [(1, -1.0), (2, 0.1)])
    got = {r.user_id: r.predict for r in E.final_submission(classifier, regressor, residual, 0.5).collect()}
    assert got == {1: 0.0, 2: pytest.approx(4 * np.exp(0.05) - 1)}
    for tables in ((classifier, regressor.limit(1), residual), (classifier, regressor, residual.union(residual))):
        with pytest.raises(ValueError):
            E.final_submission(*tables, 0.5)


def test_submission_points(spark):
    grid = spark.createDataFrame([("a", 1.0, 1.0, 0.5, 0.9, 0.3, 0.575), ("b", 1.1, 1.0, 0.6, 0.7, 0.0, 0.6)], "probability string, gamma double, scale double, rmsle double, worst_snapshot_rmsle double, std_snapshot_rmsle double, stable_score double")
    got = {r.best: (r.probability, r.gamma, r.scale) for r in E.submission_points(grid, "a").collect()}
    assert got["global"] == ("a", 1.0, 1.0) and got["worst"] == ("b", 1.1, 1.0) and got["stable"] == ("a", 1.0, 1.0) and got["baseline"] == ("a", 1.1, 1.0) and len(got) == 8
