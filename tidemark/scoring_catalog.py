"""Queries of the scoring, blending, stacking, repeat-purchase and streaming operators.

No predictions are stored, so each query makes the same ones from the orders panel: simple formulas over a user's history
at three cutoffs. Both engines can make them, so grids and blends see equal inputs.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import Query, _read, events, orders, rounded
from tidemark.operators import btyd, guards, incremental, models, networks, search, stacking, training
from tidemark.operators import evaluation as E
from tidemark.operators import sequence as S
from tidemark.operators import snapshot as N
from tidemark.plans import oracle as O
from tidemark.plans.config import EVENTS, EVENTS_SEQUENCE, ORDERS, ORDERS_SEQUENCE, SnapshotConfig
from tidemark.sources.panel import events_panel
from tidemark.sources.shared import new_path, settle
from tidemark.sources.tables import discovered, weighted
from tidemark.streaming import daily, regularity

SNAPSHOTS = {"train_cutoff_2000-07-01": "2000-07-01", "train_cutoff_2000-09-29": "2000-09-29", "train_cutoff_2000-12-28": "2000-12-28"}

#: Sums over a user's rows at a cutoff, and what the stand-in predictions are made of them.
SUMS = [
    ("target", "coalesce(sum(gmv) filter (where d < 0 and d >= -30), 0e0)"),
    ("orders_90", "cast(count(*) filter (where d >= 0 and d < 90 and to_ord > 0) as bigint)"),
    ("orders_270", "cast(count(*) filter (where d >= 0 and d < 270 and to_ord > 0) as bigint)"),
    ("gmv_270", "coalesce(sum(gmv) filter (where d >= 0 and d < 270), 0e0)"),
    ("gmv_90", "coalesce(sum(gmv) filter (where d >= 0 and d < 90), 0e0)"),
    ("old", "coalesce(sum(gmv) filter (where d >= 30 and d < 60), 0e0)"),
    ("new", "coalesce(sum(gmv) filter (where d >= 0 and d < 30), 0e0)"),
    ("last_year", "coalesce(sum(gmv) filter (where d >= 240 and d < 270), 0e0)"),
]
MADE = [
    ("positive", "case when target > 0 then 1 else 0 end"),
    ("probability", "(orders_90 + 5e-1) / (orders_270 + 2e0)"),
    ("positive_prediction", "gmv_270 / greatest(orders_270, 1)"),
    ("all_prediction", "gmv_270 / 9e0"),
    ("recent_prediction", "gmv_90 / 3e0"),
    ("residual_prediction", "(orders_90 - 1) / 4e0"),
    ("fold", "cast(user_id % 2 + 1 as integer)"),
]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = orders(spark, sf_dir)
    dates = F.array(*[F.struct(F.lit(n).alias("snapshot_name"), F.lit(d).cast("date").alias("cutoff")) for n, d in SNAPSHOTS.items()])
    met = panel.where(F.col("event_date").between("1999-10-01", "2001-02-01")).select("*", F.explode(dates).alias("s")).select("*", "s.*").withColumn("d", F.datediff("cutoff", "event_date")).where("d >= -30 and d < 270")
    summed = met.groupBy("user_id", "snapshot_name").agg(*[F.expr(t).alias(n) for n, t in SUMS])
    return summed.selectExpr("*", *[f"{t} as {n}" for n, t in MADE])


PREDICTIONS_SQL = f"""with {O.ORDERS_PANEL},
cuts(snapshot_name, cutoff) as (values {", ".join(f"('{n}', date '{d}')" for n, d in SNAPSHOTS.items())}),
met as (select p.*, snapshot_name, date_diff('day', event_date, cutoff) d from panel p, cuts where event_date <= cutoff + interval 30 day and event_date > cutoff - interval 270 day),
at_cutoff as (select user_id, snapshot_name, {", ".join(f"{t} as {n}" for n, t in SUMS)} from met group by all),
pred as (select *, {", ".join(f"{t} as {n}" for n, t in MADE)} from at_cutoff)"""

HURDLE_SQL = "greatest(0e0, power(greatest(0e0, least(1e0, probability)), {g}) * {s} * ln(1 + greatest(0e0, positive_prediction)))"
BASE_SQL = PREDICTIONS_SQL + f",\nbase as (select *, {HURDLE_SQL.format(g='1e0', s='1e0')} base_hurdle_log, ln(1 + target) target_log from pred)"


def _pred(make, keys: tuple[str, ...] = ()) -> Query:
    return lambda spark, sf_dir: rounded(make(predictions(spark, sf_dir)), keys)


def calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the same calendar windows a year apart, in SQL."""
    orders(spark, sf_dir).createOrReplaceTempView("daily_panel")
    return rounded(spark.sql(f"select user_id, {CALENDAR} from daily_panel group by user_id"))


WINDOWS = {
    "jan_target_analog": ("1999-01-15", "1999-02-13"), "jan_growth_reference_old": ("1999-01-01", "1999-01-14"), "jan_growth_reference_new": ("2000-01-01", "2000-01-14"),
    "next_target_analog": ("1999-02-14", "1999-03-15"), "next_growth_reference_old": ("1999-01-31", "1999-02-13"), "next_growth_reference_new": ("2000-01-31", "2000-02-13"),
}
CALENDAR = ", ".join(f"sum(case when event_date between date '{a}' and date '{b}' then gmv else 0e0 end) as {n}" for n, (a, b) in WINDOWS.items())


def _round_sql(text: str, names: list[str], source: str, keys: tuple[str, ...] = ()) -> str:
    head = ", ".join(keys)
    return f"{text}\nselect {head + ', ' if head else ''}{', '.join(f'round(cast({n} as double), 6) + 0e0 as {n}' for n in names)} from {source}"


def rmsle_query(p: DataFrame) -> DataFrame:
    p = E.hurdle_combine(p)
    return p.groupBy("snapshot_name").agg(E.rmsle(F.col("target"), F.col("base_hurdle_log")).alias("rmsle_hurdle"), E.rmsle(F.col("target"), F.log1p("all_prediction")).alias("rmsle_all"), F.count("*").alias("n"))


RMSLE_SQL = _round_sql(BASE_SQL + ",\nr as (select snapshot_name, sqrt(avg(power(target_log - base_hurdle_log, 2))) rmsle_hurdle, sqrt(avg(power(target_log - ln(1 + all_prediction), 2))) rmsle_all, count(*) n from base group by 1)", ["rmsle_hurdle", "rmsle_all", "n"], "r", ("snapshot_name",))

LOGLOSS_SQL = _round_sql(PREDICTIONS_SQL + ",\nr as (select snapshot_name, -avg(positive * ln(greatest(1e-6, least(1 - 1e-6, probability))) + (1 - positive) * ln(1 - greatest(1e-6, least(1 - 1e-6, probability)))) logloss from pred group by 1)", ["logloss"], "r", ("snapshot_name",))

AUC_SQL = _round_sql(PREDICTIONS_SQL + """,
ranked as (select positive, (rank() over (order by probability) + rank() over (order by probability) + count(*) over (partition by probability) - 1) / 2e0 r from pred),
r as (select (sum(r) filter (where positive = 1) - sum(positive) * (sum(positive) + 1) / 2e0) / (sum(positive) * sum(1 - positive)) auc from ranked)""", ["auc"], "r")  # fmt: skip

FOLD_SCORES_SQL = _round_sql(BASE_SQL + """,
ranked as (select *, rank() over (partition by fold order by probability) + (count(*) over (partition by fold, probability) - 1) / 2e0 r from base),
r as (
    select fold, sqrt(avg(power(target_log - base_hurdle_log, 2))) rmsle, avg(-ln(case when positive = 1 then greatest(1e-6, least(1 - 1e-6, probability)) else 1 - greatest(1e-6, least(1 - 1e-6, probability)) end)) logloss,
        (sum(r) filter (where positive = 1) - sum(positive) * (sum(positive) + 1) / 2e0) / (sum(positive) * sum(1 - positive)) auc
    from ranked group by fold
)""", ["rmsle", "logloss", "auc"], "r", ("fold",))  # fmt: skip

HURDLE_NAMES = ["base_hurdle_log", "base_hurdle_predict", "target_log"]
HURDLE_COMBINE_SQL = _round_sql(PREDICTIONS_SQL + f",\nr as (select user_id, snapshot_name, {HURDLE_SQL.format(g='1.1e0', s='1e0')} base_hurdle_log, exp({HURDLE_SQL.format(g='1.1e0', s='1e0')}) - 1 base_hurdle_predict, ln(1 + target) target_log from pred)", HURDLE_NAMES, "r", ("user_id", "snapshot_name"))

RESIDUAL_NAMES = ["residual", "residual_abs", "residual_clipped"]
RESIDUAL_SQL = _round_sql(BASE_SQL + """,
res as (select user_id, snapshot_name, target_log - base_hurdle_log residual from base),
edges as (select quantile_cont(residual, 0.005) low, quantile_cont(residual, 0.995) high from res),
r as (select user_id, snapshot_name, residual, abs(residual) residual_abs, greatest(least(residual, high), low) residual_clipped from res, edges)""", RESIDUAL_NAMES, "r", ("user_id", "snapshot_name"))  # fmt: skip


def _values(name: str, columns: str, points: list) -> str:
    rows = ", ".join("(" + ", ".join(f"cast({v!r} as double)" for v in (p if isinstance(p, tuple) else (p,))) + ")" for p in points)
    return f"{name}({columns}) as (values {rows})"


ALPHAS = E._steps(-0.3, 0.3, 0.005)
ALPHA_SQL = _round_sql(BASE_SQL + f""",
{_values("grid", "alpha", ALPHAS)},
se as (select alpha, fold, power(target_log - greatest(0e0, base_hurdle_log + alpha * residual_prediction), 2) e from base, grid),
r as (select alpha, fold, sqrt(avg(e)) rmsle from se group by 1, 2 union all select alpha, null, sqrt(avg(e)) from se group by 1)""", ["alpha", "rmsle"], "r", ("fold",))  # fmt: skip

PLATT_SQL = _round_sql(PREDICTIONS_SQL + f""",
{_values("grid", "a, b", [(a, b) for a in E._steps(0.8, 1.2, 0.05) for b in E._steps(-0.15, 0.15, 0.05)])},
z as (select positive, ln(greatest(1e-6, least(1 - 1e-6, probability)) / (1 - greatest(1e-6, least(1 - 1e-6, probability)))) z from pred),
p as (select a, b, positive, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(a * z + b))))) p from z, grid),
r as (select a, b, -avg(positive * ln(p) + (1 - positive) * ln(1 - p)) logloss from p group by 1, 2)""", ["a", "b", "logloss"], "r")  # fmt: skip

GRID_NAMES = ["gamma", "scale", "rmsle", "worst_snapshot_rmsle", "std_snapshot_rmsle", "stable_score"]
PROBABILITIES = ("probability", "probability_platt")
CALIBRATED_SQL = PREDICTIONS_SQL + f""",
{_values("platt", "a, b", [(a, b) for a in E._steps(0.8, 1.2, 0.05) for b in E._steps(-0.15, 0.15, 0.05)])},
zs as (select *, ln(greatest(1e-6, least(1 - 1e-6, probability)) / (1 - greatest(1e-6, least(1 - 1e-6, probability)))) z from pred),
losses as (select a, b, -avg(positive * ln(p) + (1 - positive) * ln(1 - p)) logloss from (select a, b, positive, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-(a * z + b))))) p from zs, platt) group by 1, 2),
calibrated as (select zs.*, 1 / (1 + exp(-(a * z + b))) probability_platt from zs, (select a, b from losses order by logloss, a, b limit 1))"""
GAMMA_SQL = CALIBRATED_SQL + f""",
{_values("gammas", "gamma", E._steps(1.0, 1.15, 0.01))}, {_values("scales", "scale", E._steps(0.96, 1.04, 0.01))},
named as (select target, snapshot_name, positive_prediction, unnest(['probability', 'probability_platt']) kind, unnest([probability, probability_platt]) probability from calibrated),
se as (select kind, gamma, scale, snapshot_name, power(ln(1 + target) - {HURDLE_SQL.format(g="gamma", s="scale")}, 2) e from named, gammas, scales),
own as (select kind, gamma, scale, snapshot_name, sqrt(avg(e)) x from se group by all),
pooled as (select kind, gamma, scale, sqrt(avg(e)) rmsle from se group by all),
r as (select kind probability, gamma, scale, any_value(rmsle) rmsle, max(x) worst_snapshot_rmsle, coalesce(stddev_samp(x), 0) std_snapshot_rmsle, any_value(rmsle) + 0.25e0 * coalesce(stddev_samp(x), 0) stable_score from own join pooled using (kind, gamma, scale) group by kind, gamma, scale),
top as (select * from r order by rmsle, probability, gamma, scale limit {E.TOP}),
best as (
    (select *, 'global' best from top order by rmsle, probability, gamma, scale limit 1) union all (select *, 'stable' best from top order by stable_score, probability, gamma, scale limit 1)
    union all (select *, 'worst' best from top order by worst_snapshot_rmsle, probability, gamma, scale limit 1)
)"""
GAMMA_GRID_SQL = _round_sql(GAMMA_SQL, GRID_NAMES, "r", ("probability",))
TOP_SQL = _round_sql(GAMMA_SQL, GRID_NAMES, "top", ("probability",))
CANDIDATES_SQL = _round_sql(GAMMA_SQL, GRID_NAMES, "best", ("probability", "best"))
LAST_SQL = "snapshot_name like '%12-28'"
SUBMISSIONS_SQL = _round_sql(GAMMA_SQL + f""",
points as (select best, probability kind, gamma, scale from best union all values ('baseline', 'probability', 1.1e0, 1e0), {", ".join(f"('{n}', 'probability', {g!r}e0, {x!r}e0)" for n, g, x in E.FIXED)}),
chosen as (select user_id, best, gamma, scale, positive_prediction, case when kind = 'probability' then probability else probability_platt end probability from calibrated, points where {LAST_SQL}),
s as (select user_id, best, exp({HURDLE_SQL.format(g="gamma", s="scale")}) - 1 predict from chosen)""", ["predict"], "s", ("user_id", "best"))  # fmt: skip


def calibrated_submissions(p: DataFrame) -> DataFrame:
    """The last snapshot's predictions at the best, baseline and fixed points of the grid."""
    p = E.platt_calibrated(p)
    points = E.submission_points(E.gamma_scale_grid(p, PROBABILITIES))
    return E.hurdle_submissions(p.where(LAST_SQL), points, PROBABILITIES)


def final_submission(p: DataFrame) -> DataFrame:
    """The last snapshot's tables of classifier, regressor and residuals put together, at the alpha that the grid accepts."""
    alpha = E.chosen_alpha(E.alpha_grid(E.hurdle_combine(p, 1.1)))
    last = p.where(LAST_SQL)
    return E.final_submission(last.select("user_id", "probability"), last.select("user_id", "positive_prediction"), last.select("user_id", "residual_prediction"), alpha)


ANALOG_SQL = "greatest(0e0, ln(1 + last_year) + {a} * (old + new) / (old + new + {k}) * greatest(-{c}, least({c}, ln(1 + new) - ln(1 + old))))"
ANALOG_LOG_SQL = _round_sql(PREDICTIONS_SQL + f",\nr as (select user_id, snapshot_name, {ANALOG_SQL.format(a='5e-1', k='1e2', c='1e0')} analog_log from pred)", ["analog_log"], "r", ("user_id", "snapshot_name"))
ANALOG_NAMES = ["gamma", "alpha", "clip", "k", "weight", "base_rmsle", "analog_rmsle", "blend_rmsle"]
ANALOG_GRID_SQL = _round_sql(PREDICTIONS_SQL + f""",
{_values("gs", "gamma", list(E.ANALOG_GAMMAS))}, {_values("als", "alpha", list(E.ANALOG_ALPHAS))}, {_values("cls", "clip", list(E.ANALOG_CLIPS))}, {_values("kk", "k", list(E.ANALOG_KS))}, {_values("ws", "weight", list(E.ANALOG_WEIGHTS))},
a2 as (select row_number() over () i, * from pred),
h as (select i, gamma, ln(1 + target) - {HURDLE_SQL.format(g="gamma", s="1e0")} eb from a2, gs),
b as (select gamma, alpha, clip, k, ln(1 + target) - {ANALOG_SQL.format(a="alpha", k="k", c="clip")} ea, eb from a2 join h using (i), als, cls, kk),
r as (select gamma, alpha, clip, k, weight, sqrt(avg(eb * eb)) base_rmsle, sqrt(avg(ea * ea)) analog_rmsle, sqrt(avg(power((1 - weight) * eb + weight * ea, 2))) blend_rmsle from b, ws group by all)""", ANALOG_NAMES, "r")  # fmt: skip

ANALOG_BEST = {"gamma": 1.1, "alpha": 0.5, "clip": 1.0, "k": 100.0}
ANALOG_SUBMISSIONS_SQL = _round_sql(PREDICTIONS_SQL + f""",
{_values("ws", "weight", [0.05, 0.1, 0.15, 0.2, 0.25])},
r as (select user_id, weight, exp(greatest(0e0, (1 - weight) * {HURDLE_SQL.format(g="1.1e0", s="1e0")} + weight * {ANALOG_SQL.format(a="5e-1", k="1e2", c="1e0")})) - 1 predict from pred, ws where {LAST_SQL})""", ["weight", "predict"], "r", ("user_id",))  # fmt: skip
FINAL_SQL = _round_sql(PREDICTIONS_SQL + f""",
base as (select *, {HURDLE_SQL.format(g="1.1e0", s="1e0")} base_hurdle_log, ln(1 + target) target_log from pred),
{_values("grid", "alpha", ALPHAS)},
scores as (select alpha, sqrt(avg(power(target_log - greatest(0e0, base_hurdle_log + alpha * residual_prediction), 2))) s from base, grid group by 1),
zero as (select s from scores where alpha = 0), won as (select alpha, s from scores order by s, alpha limit 1),
r as (select user_id, exp(greatest(0e0, base_hurdle_log + case when zero.s - won.s >= 0.001 then won.alpha else 0e0 end * residual_prediction)) - 1 predict from base, zero, won where {LAST_SQL})""", ["predict"], "r", ("user_id",))  # fmt: skip
LINE_NAMES = [f"alpha_{a:.4f}".replace(".", "_") for a in E.LINE_ALPHAS] + [f"scale_{x:.4f}".replace(".", "_") for x in E.LOG_SCALES]
LINE_SQL = _round_sql(BASE_SQL + ",\nr as (select user_id, " + ", ".join([f"exp(greatest(0e0, least(2e1, ln(1 + all_prediction) + {a!r}e0 / 5e-2 * (base_hurdle_log - ln(1 + all_prediction))))) - 1 {n}" for a, n in zip(E.LINE_ALPHAS, LINE_NAMES, strict=False)] + [f"exp(greatest(0e0, least(2e1, base_hurdle_log * {x!r}e0))) - 1 {n}" for x, n in zip(E.LOG_SCALES, LINE_NAMES[len(E.LINE_ALPHAS) :], strict=True)]) + f" from base where {LAST_SQL})", LINE_NAMES, "r", ("user_id",))

TWO_SQL = _round_sql(BASE_SQL + f""",
{_values("grid", "alpha", [round(i / 100, 6) for i in range(101)])},
r as (select alpha, sqrt(avg(power(target_log - (alpha * base_hurdle_log + (1 - alpha) * ln(1 + all_prediction)), 2))) rmsle from base, grid group by 1)""", ["alpha", "rmsle"], "r")  # fmt: skip

_A, _B, _C = "positive_prediction", "all_prediction", "recent_prediction"
SPECS = {
    "best95_all05": {_A: 0.95, _B: 0.05}, "best90_all10": {_A: 0.9, _B: 0.1}, "best95_last05": {_A: 0.95, "last_year": 0.05}, "best95_recent05": {_A: 0.95, _C: 0.05}, "best90_recent10": {_A: 0.9, _C: 0.1},
    "best92_all04_recent04": {_A: 0.92, _B: 0.04, _C: 0.04}, "best90_last05_all05": {_A: 0.9, "last_year": 0.05, _B: 0.05},
}
BLEND_SQL = _round_sql(PREDICTIONS_SQL + ",\nr as (select user_id, " + ", ".join(f"round(exp(greatest(0e0, least(2e1, {' + '.join(f'ln(1 + {m}) * {w!r}e0' for m, w in spec.items())}))) - 1, 3) as {n}" for n, spec in SPECS.items()) + " from pred where snapshot_name like '%12-28')", list(SPECS), "r", ("user_id",))

MODELS = ["positive_prediction", "all_prediction", "recent_prediction"]
STATS_NAMES = ["corr_log", "mean_pred", "median_pred", "p95_pred", "max_pred"]
STATS_SQL = _round_sql(PREDICTIONS_SQL + ",\nr as (" + " union all ".join(f"select '{m}' model, corr(ln(1 + positive_prediction), ln(1 + {m})) corr_log, avg({m}) mean_pred, quantile_cont({m}, 0.5) median_pred, quantile_cont({m}, 0.95) p95_pred, max({m}) max_pred from pred" for m in MODELS) + ")", STATS_NAMES, "r", ("model",))


def _part(p: DataFrame, column: str, keep: str) -> DataFrame:
    return p.where(keep).select("user_id", "snapshot_name", "target", F.col(column).alias("predict"))


def oof_merge(p: DataFrame, complete: bool) -> DataFrame:
    """Out-of-fold tables that lack some rows, merged on user and snapshot."""
    head = p.select("user_id", "snapshot_name", "target", F.log1p("target").alias("target_log"), "positive")
    tables = {"cat": (_part(p, "positive_prediction", "user_id % 7 <> 0"), "predict"), "lgbm": (_part(p, "all_prediction", "user_id % 5 <> 0"), "predict")}
    if complete:
        return stacking.stack(head, tables)
    out = head
    for name, (table, column) in tables.items():
        out = stacking.merge_oof(out, table, name, column)
    return out


OOF_NAMES = ["target", "target_log", "positive", "cat", "lgbm"]
OOF_SQL = PREDICTIONS_SQL + ",\nr as (select user_id, snapshot_name, target, ln(1 + target) target_log, positive, case when user_id % 7 <> 0 then positive_prediction end cat, case when user_id % 5 <> 0 then all_prediction end lgbm from pred)"


def base_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stack widened by picked snapshot features and logarithms of those about money."""
    snap = N.snapshot(orders(spark, sf_dir), ORDERS)
    names = stacking.pick_features(snap, ["gmv_30d", "order_days_90d", "gmv_per_order_day_30d", "absent"], ["gmv_9"], 4)
    return rounded(stacking.with_base_features(snap.select("user_id", "target"), snap, names))


BASE_FEATURES = ["gmv_30d", "order_days_90d", "gmv_per_order_day_30d", "gmv_90d"]
BASE_FEATURES_SQL = _round_sql(O.filled_ctes(O.ORDERS_PANEL, ORDERS) + ",\nr as (select user_id, target, gmv_30d base_gmv_30d, order_days_90d base_order_days_90d, coalesce(gmv_30d / nullif(order_days_30d, 0), 0) base_gmv_per_order_day_30d, gmv_90d base_gmv_90d, ln(1 + gmv_30d) base_gmv_30d_log1p, ln(1 + coalesce(gmv_30d / nullif(order_days_30d, 0), 0)) base_gmv_per_order_day_30d_log1p, ln(1 + gmv_90d) base_gmv_90d_log1p from filled)", ["target", *[f"base_{n}" for n in BASE_FEATURES], "base_gmv_30d_log1p", "base_gmv_per_order_day_30d_log1p", "base_gmv_90d_log1p"], "r", ("user_id",))


def expanding_folds(p: DataFrame) -> DataFrame:
    rows = E.fold_rows(p, sorted(SNAPSHOTS), 1, {"train_cutoff_2000-07-01": 0.5})
    return rows.groupBy("fold", "role", "snapshot_name").agg(F.count("*").alias("n"), F.sum("sample_weight").alias("weight"))


FOLDS_SQL = _round_sql(PREDICTIONS_SQL + """,
names as (select snapshot_name, row_number() over (order by snapshot_name) i from (select distinct snapshot_name from pred)),
folds as (select a.i - 1 fold, b.snapshot_name, case when a.i = b.i then 'valid' else 'train' end role from names a join names b on b.i <= a.i where a.i > 1),
r as (select folds.fold, role, snapshot_name, count(*) n, sum(case when snapshot_name like '%07-01' then 0.5e0 else 1e0 end) weight from pred join folds using (snapshot_name) group by all)""", ["fold", "n", "weight"], "r", ("role", "snapshot_name"))  # fmt: skip


def segments(p: DataFrame) -> DataFrame:
    p = E.hurdle_combine(p).withColumn("segment", F.when(F.col("orders_270") == 0, "never").when(F.col("new") > 0, "0_30").when(F.col("orders_90") > 0, "31_90").otherwise("91_plus"))
    return E.segment_scores(p, "base_hurdle_log")


SEGMENTS_SQL = _round_sql(BASE_SQL + ",\nr as (select case when orders_270 = 0 then 'never' when new > 0 then '0_30' when orders_90 > 0 then '31_90' else '91_plus' end segment, count(*) n, sqrt(avg(power(target_log - base_hurdle_log, 2))) rmsle from base group by 1)", ["n", "rmsle"], "r", ("segment",))
CALIBRATION_SQL = _round_sql(BASE_SQL + ",\nr as (select regr_slope(target_log, base_hurdle_log) slope, regr_intercept(target_log, base_hurdle_log) bias from base)", ["slope", "bias"], "r")
REPORT_SQL = _round_sql(PREDICTIONS_SQL + ",\nr as (select count(*) n_rows, count(distinct (user_id, snapshot_name)) n_keys, count(*) filter (where probability is null) n_null, count(*) filter (where isnan(probability)) n_nan, count(*) filter (where probability < 0) n_negative from pred)", ["n_rows", "n_keys", "n_null", "n_nan", "n_negative"], "r")


def _logs(p: DataFrame) -> DataFrame:
    segment = F.when(F.col("orders_270") == 0, "never").when(F.col("new") > 0, "0_30").when(F.col("orders_90") > 0, "31_90").otherwise("91_plus")
    return p.select("snapshot_name", segment.alias("segment"), "target", *[F.log1p(m).alias(m) for m in MODELS])


def simplex_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, weight: the best convex blend in log space."""
    found = E.simplex_weights(_logs(predictions(spark, sf_dir)), MODELS)
    return rounded(spark.createDataFrame(list(found.items()), "model string, weight double"), ("model",))


def segment_weights(p: DataFrame) -> DataFrame:
    """The blend of each segment, fitted on all snapshots but the last."""
    return E.segment_weights(_logs(p).where(F.col("snapshot_name") != LAST), MODELS, least=LEAST_ROWS)


def segment_blend_scores(p: DataFrame) -> DataFrame:
    """By segment of the last snapshot, the error of one blend for all and of the segments' own ones; both are fitted on the others."""
    logs = _logs(p)
    others, last = logs.where(F.col("snapshot_name") != LAST), logs.where(F.col("snapshot_name") == LAST)
    overall = E.simplex_weights(others, MODELS)
    blended = E.segment_blend(last, E.segment_weights(others, MODELS, least=LEAST_ROWS), overall).withColumn("all_log", sum((F.col(m) * w for m, w in overall.items()), F.lit(0.0)))
    return blended.groupBy("segment").agg(F.count("*").alias("n"), E.rmsle(F.col("target"), F.col("all_log")).alias("rmsle_overall"), E.rmsle(F.col("target"), F.col("blend_log")).alias("rmsle_segments"))


LAST, LEAST_ROWS = list(SNAPSHOTS)[-1], 200
LOGS_SQL = PREDICTIONS_SQL + f""",
logs as (select snapshot_name, case when orders_270 = 0 then 'never' when new > 0 then '0_30' when orders_90 > 0 then '31_90' else '91_plus' end segment,
  ln(1 + target) t, {", ".join(f"ln(1 + {m}) m{i}" for i, m in enumerate(MODELS))} from pred),
errs as (select *, t - m0 x, t - m1 y, t - m2 z from logs)"""


def _weights_sql(name: str, source: str, key: str) -> str:
    """A table of the least convex combination of three models by key: every side of the triangle, then its inside by Cramer's rule."""
    return f""",
{name}_g as (select {key} k, count(*) n, avg(x * x) a, avg(x * y) b, avg(x * z) c, avg(y * y) d, avg(y * z) e, avg(z * z) f from {source} group by 1),
{name}_i as (select *, d*f - e*e + c*e - b*f + b*e - c*d p, c*e - b*f + a*f - c*c + b*c - a*e q, b*e - c*d + b*c - a*e + a*d - b*b r from {name}_g),
{name}_c as (
  select *, 1 o, 1e0 w0, 0e0 w1, 0e0 w2 from {name}_i union all select *, 2, 0, 1, 0 from {name}_i union all select *, 3, 0, 0, 1 from {name}_i
  union all select *, 4, (d - b) / nullif(a + d - 2*b, 0), (a - b) / nullif(a + d - 2*b, 0), 0 from {name}_i
  union all select *, 5, (f - c) / nullif(a + f - 2*c, 0), 0, (a - c) / nullif(a + f - 2*c, 0) from {name}_i
  union all select *, 6, 0, (f - e) / nullif(d + f - 2*e, 0), (d - e) / nullif(d + f - 2*e, 0) from {name}_i
  union all select *, 7, p / nullif(p + q + r, 0), q / nullif(p + q + r, 0), r / nullif(p + q + r, 0) from {name}_i),
{name}_v as (select *, w0*w0*a + w1*w1*d + w2*w2*f + 2*(w0*w1*b + w0*w2*c + w1*w2*e) v from {name}_c where w0 >= 0 and w1 >= 0 and w2 >= 0),
{name}_m as (select k, min(v) least_v from {name}_v group by 1),
{name} as (select v.k, any_value(n) n, arg_min(w0, o) w0, arg_min(w1, o) w1, arg_min(w2, o) w2 from {name}_v v join {name}_m m on v.k = m.k where v <= least_v + 1e-9 group by 1)"""


SIMPLEX_SQL = _round_sql(LOGS_SQL + _weights_sql("w", "errs", "0") + ",\nr as (" + " union all ".join(f"select '{m}' model, w{i} weight from w" for i, m in enumerate(MODELS)) + ")", ["weight"], "r", ("model",))
FITTED_SQL = LOGS_SQL + f",\nothers as (select * from errs where snapshot_name <> '{LAST}')" + _weights_sql("one", "others", "0") + _weights_sql("own", "others", "segment")
FITTED_SQL += f",\nfitted as (select own.k segment, own.n, {', '.join(f'case when own.n >= {LEAST_ROWS} then own.w{i} else one.w{i} end weight_{m}' for i, m in enumerate(MODELS))} from own, one)"
SEGMENT_WEIGHTS_SQL = _round_sql(FITTED_SQL, ["n", *[f"weight_{m}" for m in MODELS]], "fitted", ("segment",))
SEGMENT_BLEND_SQL = _round_sql(
    FITTED_SQL
    + f""",
r as (select segment, count(*) n, sqrt(avg(power(t - ({" + ".join(f"one.w{i} * m{i}" for i in range(3))}), 2))) rmsle_overall,
  sqrt(avg(power(t - ({" + ".join(f"coalesce(fitted.weight_{m}, one.w{i}) * m{i}" for i, m in enumerate(MODELS))}), 2))) rmsle_segments
  from errs left join fitted using (segment), one where snapshot_name = '{LAST}' group by 1)""",
    ["n", "rmsle_overall", "rmsle_segments"], "r", ("segment",),
)


def btyd_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(btyd.summary(orders(spark, sf_dir), ORDERS.cutoff))


BTYD_SQL = _round_sql(f"with {O.ORDERS_PANEL},\nb as (select user_id, count(distinct event_date) - 1 frequency, date_diff('day', min(event_date), max(event_date)) recency, date_diff('day', min(event_date), date '{ORDERS.cutoff}') T, avg(gmv) monetary_value from panel where gmv > 0 and event_date <= date '{ORDERS.cutoff}' group by 1),\nr as (select user_id, coalesce(frequency, 0) frequency, coalesce(recency, 0) recency, coalesce(T, 0) T, coalesce(monetary_value, 0) monetary_value from (select distinct user_id from panel) left join b using (user_id))", ["frequency", "recency", "T", "monetary_value"], "r", ("user_id",))


def bgnbd_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = btyd.summary(orders(spark, sf_dir), ORDERS.cutoff)
    return btyd.expected_purchases(rows, btyd.fit_bgnbd(rows))


def gamma_gamma_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = btyd.summary(orders(spark, sf_dir), ORDERS.cutoff)
    return btyd.expected_spend(rows, btyd.fit_gamma_gamma(rows))


GBT_FEATURES = ["orders_90", "orders_270", "gmv_270", "gmv_90", "old", "new", "last_year"]


def gbt_hurdle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted two-stage forecasts of the last snapshot, learned from those before it."""
    keep = ["user_id", "snapshot_name", "target", *GBT_FEATURES]
    rows = predictions(spark, sf_dir).select(*keep)
    return models.backtest(rows, GBT_FEATURES, sorted(SNAPSHOTS), first=1)


def boosted_hurdle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage forecasts of the last snapshot by boosted histograms, learned from those before it, stopped early by held-out users."""
    rows = predictions(spark, sf_dir).select("user_id", "snapshot_name", "target", *GBT_FEATURES)
    *before, last = sorted(SNAPSHOTS)
    learned = models.fit_boosted_hurdle(rows.where(F.col("snapshot_name").isin(before)), GBT_FEATURES)
    return models.predict_boosted_hurdle(learned, rows.where(F.col("snapshot_name") == last))


def gru_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts in log space of the events' second cutoff by a recurrent network that is trained on the first."""
    panel, before, last = events(spark, sf_dir), replace(EVENTS_SEQUENCE, cutoff="2024-01-10"), EVENTS_SEQUENCE
    log = F.log1p("target")
    tensors = [S.log_tensors(panel, c).select("user_id", F.lit(c.cutoff).alias("snapshot_name"), "tensor", log.alias("target")) for c in (before, last)]
    rows = settle(tensors[0].unionByName(tensors[1]), "tensors")
    return training.out_of_fold(networks.gru(len(S.VALUES), 16), rows, [before.cutoff, last.cutoff], name="pred_log", epochs=3, batches=8, rate=0.01)


TCN_COLUMNS = ("gmv", "gmv_search", "to_ord", "searches")


def tcn_residual_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot's hurdle with residuals of a convolutional network, which sees earlier snapshots alone, at the alpha that the grid accepts for the one before."""
    panel, names = orders(spark, sf_dir), sorted(SNAPSHOTS)
    p = settle(E.residuals(E.hurdle_combine(predictions(spark, sf_dir).drop("fold", "residual_prediction"), 1.1)), "predictions")
    tensors = None
    for name in names:
        own = S.log_tensors(panel, replace(ORDERS_SEQUENCE, cutoff=SNAPSHOTS[name], history=90), TCN_COLUMNS).withColumn("snapshot_name", F.lit(name))
        tensors = own if tensors is None else tensors.unionByName(own)
    rows = settle(tensors.drop("target").join(p.select("user_id", "snapshot_name", F.col("residual_clipped").alias("target")), ["user_id", "snapshot_name"]), "tensors")
    found = training.out_of_fold(networks.tcn(len(TCN_COLUMNS), 16), rows, names, epochs=2, batches=6, rate=0.01)
    scored = settle(p.join(found, ["user_id", "snapshot_name"]), "residuals")
    alpha = E.chosen_alpha(E.alpha_grid(scored.where(F.col("snapshot_name") == names[-2])))
    last = scored.where(F.col("snapshot_name") == names[-1])
    return E.final_submission(*(last.select("user_id", c) for c in ("probability", "positive_prediction", "residual_prediction")), alpha)


def hurdle_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of a search for the hurdle's exponent, scale and bias, four at once, each one aggregation over all predictions."""
    p = settle(predictions(spark, sf_dir).select("target", "probability", "positive_prediction"), "predictions")

    def error(x: dict) -> float:
        log = F.greatest(F.lit(0.0), E.hurdle_log(F.col("probability"), F.col("positive_prediction"), x["gamma"], x["scale"]) + x["bias"])
        return p.agg(E.rmsle(F.col("target"), log)).first()[0]

    space = {"gamma": search.Range(0.5, 2.0), "scale": search.Range(0.25, 1.5, log=True), "bias": search.Range(-0.5, 1.5)}
    store = search.Trials(spark, new_path(spark, "trials"))
    search.search(error, space, 20, store, seed=7)
    return store.table()


FILE_COLUMNS = "user_id long, target double, gmv_270 double"
FILE_WEIGHTS = {"train_cutoff_2000-09-29": 2.0, "train_cutoff_2000-12-28": 3.0}


def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots written to folders of their own, then found by their files, named by their paths, weighed and summed."""
    root = new_path(spark, "snapshots")
    rows = settle(predictions(spark, sf_dir).select("user_id", "snapshot_name", "target", "gmv_270"), "predictions")
    for k, name in enumerate(sorted(SNAPSHOTS)):
        rows.where(F.col("snapshot_name") == name).drop("snapshot_name").write.parquet(f"{root}/part_{k}/deep/{name}.snapshot")
    found = weighted(discovered(spark, root, FILE_COLUMNS, names=sorted(SNAPSHOTS)), FILE_WEIGHTS)
    sums = found.groupBy("snapshot_name").agg(F.count("*").alias("n"), F.round(F.sum("target"), 2).alias("target"), F.round(F.sum(F.col("gmv_270") * F.col("sample_weight")), 2).alias("weighed"))
    return rounded(sums, ("snapshot_name",))


FILES_SQL = _round_sql(PREDICTIONS_SQL + f""",
r as (select snapshot_name, count(*) n, round(sum(target), 2) target, round(sum(gmv_270 * case snapshot_name {" ".join(f"when '{k}' then {w}e0" for k, w in FILE_WEIGHTS.items())} else 1e0 end), 2) weighed from pred group by 1)""", ["n", "target", "weighed"], "r", ("snapshot_name",))  # fmt: skip


def streaming_daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed days of the events read as a stream, in one available-now run."""
    source = _read(spark, sf_dir, "events")
    path = new_path(spark, "stream")
    stream = daily.daily_stream(spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*"))
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out"), ("user_id", "event_date"))


REGULAR_NAMES = [n for n, _ in regularity.columns(EVENTS.recency) if "days_since" not in n]


def streaming_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and streaks of the events' cutoff, kept as state of a stream; users that the stream has nothing of get zeros."""
    source = _read(spark, sf_dir, "events")
    path = new_path(spark, "stream")
    with regularity.state_store(spark):
        stream = regularity.regularity_stream(spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*"), regularity.Schedule(EVENTS.cutoff, EVENTS.recency, last=EVENTS.cutoff))
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{path}/out")
    return rounded(N.users_of(source).select(F.col("user_id").cast("long")).distinct().join(rows, "user_id", "left").selectExpr("user_id", *[f"coalesce({n}, 0) as {n}" for n in REGULAR_NAMES]))


def late_events_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' snapshot, finished before a third of all events came, and mended for them in two versions."""
    rows = _read(spark, sf_dir, "events")
    wave = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(6))
    store = incremental.SnapshotStore(spark, new_path(spark, "versions"), EVENTS, buckets=8)
    store.build(events_panel(rows.where(wave > 1)))
    for late in (0, 1):
        store.apply(events_panel(rows.where(wave == late)))
    return rounded(store.current(), ("user_id", "cutoff_date"))


STREAM_SQL = _round_sql("""with d as (
    select user_id, cast(ts as date) event_date, count(*) filter (where event_type = 'view') searches, count(*) filter (where event_type = 'click') to_cart,
        count(*) filter (where event_type = 'purchase') to_ord, coalesce(sum(value) filter (where event_type = 'purchase'), 0) gmv
    from events group by 1, 2
),
r as (select * from d where event_date + interval 1 day <= (select max(ts) - interval 2 day from events))""", ["searches", "to_cart", "to_ord", "gmv"], "r", ("user_id", "event_date"))  # fmt: skip


def sequence_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of several weekly cutoffs of the events, one below the other."""
    panel = events(spark, sf_dir)
    out = None
    for day in N.cutoffs("2024-01-06", "2024-01-13", 7, last="2024-01-20"):
        c = SnapshotConfig(**(EVENTS.__dict__ | {"cutoff": day}))
        one = N.snapshot(panel, c).select("user_id", "cutoff_date", "target", "gmv_7d", "days_since_last_order_20d")
        out = one if out is None else out.unionByName(one)
    return rounded(out, ("user_id", "cutoff_date"))


CUTOFFS_SQL = f"""with {O.EVENTS_PANEL},
cuts(cutoff) as (values (date '2024-01-06'), (date '2024-01-13'), (date '2024-01-20')),
m as (select u.user_id, cutoff, p.event_date, gmv, to_ord, date_diff('day', p.event_date, cutoff) d from (select distinct user_id from panel) u cross join cuts left join panel p on p.user_id = u.user_id and p.event_date > cutoff - interval 20 day and p.event_date <= cutoff + interval 10 day)
select user_id, cutoff cutoff_date, round(coalesce(sum(gmv) filter (where d < 0), 0), 6) + 0e0 target, round(coalesce(sum(gmv) filter (where d >= 0 and d < 7), 0), 6) + 0e0 gmv_7d, cast(coalesce(min(d) filter (where d >= 0 and to_ord > 0), 21) as double) days_since_last_order_20d from m group by 1, 2"""


def entries() -> dict[str, tuple[Query, str | None]]:
    us = ("user_id", "snapshot_name")
    last = "snapshot_name = 'train_cutoff_2000-12-28'"
    return {
        "calendar_windows_sql": (calendar_windows, _round_sql(f"with {O.ORDERS_PANEL},\nr as (select user_id, {CALENDAR} from panel group by user_id)", list(WINDOWS), "r", ("user_id",))),
        "rmsle": (_pred(rmsle_query, ("snapshot_name",)), RMSLE_SQL),
        "logloss": (_pred(lambda p: p.groupBy("snapshot_name").agg(E.logloss(F.col("positive"), F.col("probability")).alias("logloss")), ("snapshot_name",)), LOGLOSS_SQL),
        "auc": (_pred(lambda p: E.auc(p, "positive", "probability")), AUC_SQL),
        "fold_scores": (_pred(lambda p: models.fold_scores(E.hurdle_combine(p).withColumn("pred_log", F.col("base_hurdle_log"))), ("fold",)), FOLD_SCORES_SQL),
        "hurdle_combine": (_pred(lambda p: E.hurdle_combine(p, 1.1).select(*us, *HURDLE_NAMES), us), HURDLE_COMBINE_SQL),
        "residual_winsorised": (_pred(lambda p: E.residuals(E.hurdle_combine(p)).select(*us, *RESIDUAL_NAMES), us), RESIDUAL_SQL),
        "alpha_grid": (_pred(lambda p: E.alpha_grid(E.hurdle_combine(p)), ("fold",)), ALPHA_SQL),
        "platt_grid": (_pred(E.platt_grid), PLATT_SQL),
        "gamma_scale_grid": (_pred(lambda p: E.gamma_scale_grid(E.platt_calibrated(p), PROBABILITIES), ("probability",)), GAMMA_GRID_SQL),
        "gamma_scale_top": (_pred(lambda p: E.top_points(E.gamma_scale_grid(E.platt_calibrated(p), PROBABILITIES)), ("probability",)), TOP_SQL),
        "grid_candidates": (_pred(lambda p: E.candidates(E.top_points(E.gamma_scale_grid(E.platt_calibrated(p), PROBABILITIES))), ("probability", "best")), CANDIDATES_SQL),
        "calibrated_submissions": (_pred(calibrated_submissions, ("user_id", "best")), SUBMISSIONS_SQL),
        "final_submission": (_pred(final_submission, ("user_id",)), FINAL_SQL),
        "analog_submissions": (_pred(lambda p: E.analog_submissions(p.where(last), ANALOG_BEST), ("user_id",)), ANALOG_SUBMISSIONS_SQL),
        "line_and_scale": (_pred(lambda p: E.line_and_scale(E.hurdle_combine(p.where(last)).withColumn("all_log", F.log1p("all_prediction")), "all_log", "base_hurdle_log"), ("user_id",)), LINE_SQL),
        "analog_log": (_pred(lambda p: p.select(*us, E.analog_log(F.log1p("last_year"), F.col("old"), F.col("new"), 0.5, 1.0, 100.0).alias("analog_log")), us), ANALOG_LOG_SQL),
        "analog_grid": (_pred(E.analog_grid), ANALOG_GRID_SQL),
        "two_model_grid": (_pred(lambda p: E.two_model_grid(E.hurdle_combine(p).withColumn("all_log", F.log1p("all_prediction")), "base_hurdle_log", "all_log")), TWO_SQL),
        "log_blend": (_pred(lambda p: E.log_blend(p.where(last), SPECS).select("user_id", *[F.round(n, 3).alias(n) for n in SPECS]), ("user_id",)), BLEND_SQL),
        "corr_logs": (_pred(lambda p: E.prediction_stats(p, "positive_prediction", MODELS), ("model",)), STATS_SQL),
        "oof_merge": (_pred(lambda p: oof_merge(p, False), us), _round_sql(OOF_SQL, OOF_NAMES, "r", us)),
        "complete_case": (_pred(lambda p: oof_merge(p, True), us), _round_sql(OOF_SQL, OOF_NAMES, "r where cat is not null and lgbm is not null", us)),
        "stack_base_features": (base_features, BASE_FEATURES_SQL),
        "expanding_folds": (_pred(expanding_folds, ("role", "snapshot_name")), FOLDS_SQL),
        "segment_scores": (_pred(segments, ("segment",)), SEGMENTS_SQL),
        "linear_calibration": (_pred(lambda p: E.linear_calibration(E.hurdle_combine(p), "base_hurdle_log")), CALIBRATION_SQL),
        "prediction_report": (_pred(lambda p: guards.prediction_report(p, "probability", ["user_id", "snapshot_name"])), REPORT_SQL),
        "weekly_cutoffs": (sequence_cutoffs, CUTOFFS_SQL),
        "btyd_summary": (btyd_summary, BTYD_SQL),
        "streaming_daily_panel": (streaming_daily_panel, STREAM_SQL),
        "streaming_regularity": (streaming_regularity, O.base_sql(O.EVENTS_PANEL, EVENTS, REGULAR_NAMES)),
        "late_events_snapshot": (late_events_snapshot, O.snapshot_sql(O.EVENTS_PANEL, EVENTS, N.feature_names(EVENTS))),
        "simplex_weights": (simplex_weights, SIMPLEX_SQL),
        "segment_weights": (_pred(segment_weights, ("segment",)), SEGMENT_WEIGHTS_SQL),
        "segment_blend_scores": (_pred(segment_blend_scores, ("segment",)), SEGMENT_BLEND_SQL),
        "bgnbd_expected": (bgnbd_expected, None),
        "gamma_gamma_spend": (gamma_gamma_spend, None),
        "gbt_hurdle": (gbt_hurdle, None),
        "boosted_hurdle": (boosted_hurdle, None),
        "gru_forecast": (gru_forecast, None),
        "tcn_residual_submission": (tcn_residual_submission, None),
        "hurdle_search": (hurdle_search, None),
        "snapshot_files": (snapshot_files, FILES_SQL),
    }
