"""Sequence features: one row per user and observed day of the last months, from frames over the calendar day.

All frames partition by user and order by day_index, so the whole set takes one shuffle and one sort. Frames are ranges
over days, never rows: days without a row count as zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import change, ratio
from tidemark.plans.config import SequenceConfig
from tidemark.sources.panel import COUNTS, FLAGS, MONEY

VALUES = (*FLAGS, *COUNTS, *MONEY)
Definitions = list[tuple[str, str]]


def sequence_days(panel: DataFrame, c: SequenceConfig) -> DataFrame:
    """user_id, event_date, day_index, values and target. Users without history get one row of day_index -1, date null."""
    cutoff = F.lit(c.cutoff).cast("date")
    ahead = panel.where(F.col("event_date").between(F.date_add(cutoff, 1), F.date_add(cutoff, c.horizon)))
    targets = ahead.groupBy("user_id").agg(F.sum("gmv").alias("target"))
    users = panel.select("user_id").distinct().join(targets, "user_id", "left").select("user_id", F.coalesce("target", F.lit(0.0)).alias("target"))
    past = panel.where(F.col("event_date").between(F.date_sub(cutoff, c.history - 1), cutoff))
    past = past.select("user_id", "event_date", F.datediff("event_date", F.date_sub(cutoff, c.history - 1)).alias("day_index"), *VALUES)
    kinds = dict(panel.dtypes)
    rows = users.join(past, "user_id", "left")  # the users' left rows are those without history
    return rows.select("user_id", "event_date", F.coalesce("day_index", F.lit(-1)).alias("day_index"), *[F.coalesce(F.col(v), F.lit(0).cast(kinds[v])).alias(v) for v in VALUES], "target")


def cutoff_state_rows(days: DataFrame, c: SequenceConfig) -> DataFrame:
    """days with a row of zeros on the cutoff for each user that has none there, marked by cutoff_state_row = 1."""
    last = c.history - 1
    have = days.groupBy("user_id").agg(F.max("day_index").alias("_last"), F.first("target").alias("target")).where(F.col("_last") != last)
    kinds = dict(days.dtypes)
    state = have.select("user_id", F.lit(c.cutoff).cast("date").alias("event_date"), F.lit(last).alias("day_index"), *[F.lit(0).cast(kinds[v]).alias(v) for v in VALUES], "target", F.lit(1).alias("cutoff_state_row"))
    return days.withColumn("cutoff_state_row", F.lit(0)).unionByName(state)


def calendar(c: SequenceConfig) -> Definitions:
    """Where {dow} counts days from Monday (0) and {doy} days of the year: they differ between engines."""
    turn = {"day_of_week": ("{dow}", "7"), "day_of_year": ("{doy}", "365.25e0")}
    return [
        ("observed_day", "1 - cutoff_state_row"), ("day_index_norm", f"day_index / {c.history - 1}e0"),
        ("days_since_prev_observed", "day_index - coalesce(lag(day_index) over w, -1)"), ("calendar_is_weekend", "case when {dow} >= 5 then 1 else 0 end"),
        *((f"calendar_{n}_{f}", f"{f}(2 * pi() * {x} / {by})") for n, (x, by) in turn.items() for f in ("sin", "cos")),
    ]


def _frame(days_before: int, days_until: int = 0) -> str:
    until = f"{days_until} preceding" if days_until else "current row"
    return f"over (partition by user_id order by day_index range between {days_before} preceding and {until})"


def lags(c: SequenceConfig) -> Definitions:
    """Values of exactly so many days before, 0 where there is no row; whether that day was observed."""
    return [x for n in c.lags for x in ((f"lag_observed_{n}d", f"coalesce(max(1 - cutoff_state_row) {_frame(n, n)}, 0)"), *((f"lag_{m}_{n}d", f"coalesce(sum({m}) {_frame(n, n)}, 0)") for m in c.main))]


def _rolled(m: str, n: int) -> str:
    return f"sum({m}) {_frame(n - 1)}"


def rolling(c: SequenceConfig) -> Definitions:
    out: Definitions = []
    for n in c.rolling:
        seen = f"greatest(least({n}, day_index + 1), 1)"
        for m in c.main:
            out.append((f"roll_{m}_sum_{n}d", _rolled(m, n)))
            if n in c.detail:
                mean = f"(cast({_rolled(m, n)} as double) / {seen})"
                out += [
                    (f"roll_{m}_std_{n}d", f"sqrt(greatest({_rolled(f'cast({m} as double) * {m}', n)} / {seen} - {mean} * {mean}, 0e0))"),
                    (f"roll_{m}_nonzero_share_{n}d", f"cast({_rolled(f'case when {m} > 0 then 1 else 0 end', n)} as double) / {seen}"),
                ]
    return out


def ewm(c: SequenceConfig) -> Definitions:
    """Exponentially weighted means over calendar days, without a correction for the start."""
    out: Definitions = []
    for h in c.half_lives:
        keep = 0.5 ** (1 / h)
        run = "over (partition by user_id order by day_index rows between unbounded preceding and current row)"
        out += [(f"ewm_{m}_halflife_{h}d", f"power({keep!r}e0, day_index) * sum({1 - keep!r}e0 * {m} * power({keep!r}e0, -day_index)) {run}") for m in c.main]
    return out


def trends(c: SequenceConfig) -> Definitions:
    pairs = [(r, w) for r, w in ((7, 14), (30, 60)) if r in c.rolling and w in c.rolling]
    return [(f"trend_{m}_{r}_vs_previous_{r}d", change(f"cast({_rolled(m, r)} as double)", f"cast({_rolled(m, w)} - {_rolled(m, r)} as double)")) for m in c.main for r, w in pairs]


def recency(c: SequenceConfig) -> Definitions:
    out: Definitions = []
    for m in c.main:
        last = f"max(case when {m} > 0 then day_index end) over (partition by user_id order by day_index rows between unbounded preceding and current row)"
        out += [(f"days_since_{m}", f"coalesce(day_index - {last}, {c.history + 1})"), (f"never_{m}", f"case when {last} is null then 1 else 0 end")]
    return out


def ratios(c: SequenceConfig) -> Definitions:
    n = 30
    pairs = (
        ("conv_search_to_cart", "search_to_cart", "searches"), ("conv_search_to_order", "search_to_ord", "searches"), ("conv_cart_to_order", "to_ord", "to_cart"), ("search_gmv_share", "gmv_search", "gmv"),
        ("search_order_share", "search_to_ord", "to_ord"), ("cat_order_share", "cat_to_ord", "to_ord"), ("gmv_per_order", "gmv", "to_ord"),
    )
    return [(f"{name}_{n}d", ratio(_rolled(a, n), _rolled(b, n))) for name, a, b in pairs]


FAMILIES = {"seq_calendar": calendar, "seq_lags": lags, "seq_rolling": rolling, "seq_ewm": ewm, "seq_trends": trends, "seq_recency": recency, "seq_ratios": ratios}


def family_texts(family: str, c: SequenceConfig, dow: str = "weekday(event_date)", doy: str = "dayofyear(event_date)") -> Definitions:
    own = "over (partition by user_id order by day_index)"
    return [(name, text.replace("{dow}", dow).replace("{doy}", doy).replace("over w", own)) for name, text in FAMILIES[family](c)]


def features(rows: DataFrame, c: SequenceConfig, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """rows (with cutoff state rows) and their features. Rows of day_index -1 take no part in frames and have zeros."""
    texts = [x for f in families for x in family_texts(f, c)]
    real = rows.where("day_index >= 0").selectExpr("*", *[f"{text} as {name}" for name, text in texts])
    kinds = dict(real.dtypes)
    bare = rows.where("day_index < 0").select("*", *[F.lit(0).cast(kinds[name]).alias(name) for name, _ in texts])
    return real.unionByName(bare)


def sequence_features(panel: DataFrame, c: SequenceConfig) -> DataFrame:
    return features(cutoff_state_rows(sequence_days(panel, c), c), c)


def dense(rows: DataFrame, columns: list[str], c: SequenceConfig) -> DataFrame:
    """user_id and tensor: history x columns floats, zeros on days without a row. A user's rows are at most the history."""
    values = F.array(*[F.col(x).cast("float") for x in columns])
    own = rows.where("day_index >= 0").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("day_index", values.alias("v")))).alias("days"))
    every = rows.select("user_id").distinct().join(own, "user_id", "left")
    none = F.array_repeat(F.lit(0.0).cast("float"), len(columns))
    return every.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(c.history - 1)), lambda i: F.coalesce(F.try_element_at("days", i), none)).alias("tensor"))


def log_tensors(panel: DataFrame, c: SequenceConfig, columns: tuple[str, ...] = VALUES) -> DataFrame:
    """user_id, tensor of log1p of the columns' daily values, and the target in money, for every user of the panel."""
    rows = cutoff_state_rows(sequence_days(panel, c), c)
    targets = rows.groupBy("user_id").agg(F.first("target").alias("target"))
    logs = F.transform("tensor", lambda day: F.transform(day, lambda x: F.log1p(F.greatest(x, F.lit(0.0).cast("float"))).cast("float")))
    return dense(rows, list(columns), c).join(targets, "user_id").select("user_id", logs.alias("tensor"), "target")
