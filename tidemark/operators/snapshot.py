"""The classic snapshot: one row per user at a cutoff, from nothing after it but the target.

One shuffle by user feeds all that follows: sums over windows, blocks and weekends are conditional aggregates of a single
pass; gaps, streaks and the last orders take window functions over the same partitioning; derived features are projections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tidemark.plans import features as P
from tidemark.plans.config import SnapshotConfig

PERCENTILE = "percentile({x}, {q})"
DISTINCT = "size(collect_set({x}))"


def add_flags(panel: DataFrame) -> DataFrame:
    """The panel with its day flags as 0 or 1."""
    return panel.select("*", *[F.expr(f"case when {text} then 1 else 0 end").alias(name) for name, text in P.DAY_FLAGS])


def add_calendar(panel: DataFrame, week_origin: str) -> DataFrame:
    """week (7-day bins from the origin on, not ISO weeks), month (since year 0), weekend (0 or 1), phase of the month."""
    day = F.col("event_date")
    of_month = F.dayofmonth(day)
    phase = F.when(of_month <= 7, P.PHASES[0]).when(of_month <= 15, P.PHASES[1]).when(of_month <= 23, P.PHASES[2]).otherwise(P.PHASES[3])
    return panel.select(
        "*",
        F.floor(F.datediff(day, F.lit(week_origin).cast("date")) / 7).cast("int").alias("week"),
        (F.year(day) * 12 + F.month(day)).alias("month"),
        (F.weekday(day) >= 5).cast("int").alias("weekend"),
        phase.alias("phase"),
    )


def history(panel: DataFrame, c: SnapshotConfig) -> DataFrame:
    """The panel's rows from the recency window to the end of the target, flagged, with d; partitioned by user."""
    cutoff = F.lit(c.cutoff).cast("date")
    near = panel.where(F.col("event_date").between(F.date_sub(cutoff, c.recency - 1), F.date_add(cutoff, c.horizon)))
    return add_calendar(add_flags(near), c.week_origin).withColumn("d", F.datediff(cutoff, F.col("event_date"))).repartition("user_id")


def named(texts: P.Definitions) -> list[str]:
    """SQL text for selectExpr, which takes hundreds of columns in one call."""
    return [f"{text} as {name}" for name, text in texts]


def _aggregate(rows: DataFrame, texts: P.Definitions) -> DataFrame:
    return rows.groupBy("user_id").agg(*map(F.expr, named(texts)))


def base(h: DataFrame, c: SnapshotConfig) -> DataFrame:
    """All sums, maxima, recencies and distributions over the history: one aggregation."""
    texts = [
        *P.window_sums(c), *P.window_squares(c), *P.window_maxima(c), *P.blocks(c), *P.target(c), *P.recency(c), *P.distinct_periods(c, DISTINCT),
        *P.weekends(c), *P.last_order_day(c), *P.order_day_money(c, PERCENTILE), *P.phases(c), *P.decays(c),
    ]
    return _aggregate(h, texts)


def ranked(h: DataFrame) -> DataFrame:
    """h with order_rank (1 for the last order day) and last_order (its d), of the rows up to the cutoff."""
    return h.selectExpr(
        "*",
        "row_number() over (partition by user_id, d >= 0 order by 1 - order_day, d) as order_rank",
        "min(case when order_day = 1 and d >= 0 then d end) over (partition by user_id) as last_order",
    )


def last_orders(h: DataFrame, c: SnapshotConfig) -> DataFrame:
    """Values of the last three order days, and sums strictly after the last."""
    return _aggregate(ranked(h), P.last_orders(c) + P.after_last_order(c))


def event_days(h: DataFrame) -> DataFrame:
    """user_id, event, d, gap, length: a row for each day of each regular event, with the days since the event's day before and those of its run so far."""
    kinds = F.filter(F.array(*[F.when(F.col(P.EVENTS[e]) == 1, F.lit(e)) for e in P.REGULAR]), lambda x: x.isNotNull())
    long = h.where("d >= 0").select("user_id", "d", F.explode(kinds).alias("event"))
    gaps = long.selectExpr("user_id", "event", "d", "lag(d) over (partition by user_id, event order by d desc) - d as gap")
    return gaps.selectExpr("*", "min(case when gap = 1 then null else d end) over (partition by user_id, event order by d desc rows between unbounded preceding and current row) - d + 1 as length")


def gaps(h: DataFrame, c: SnapshotConfig) -> DataFrame:
    return _aggregate(event_days(h), P.gaps(c, PERCENTILE))


def streaks(h: DataFrame, c: SnapshotConfig) -> DataFrame:
    return _aggregate(event_days(h), P.streaks(c))


def users_of(panel: DataFrame) -> DataFrame:
    """Every user of the source has a row at every cutoff, with or without history."""
    return panel.select("user_id").distinct()


def zero_filled(spine: DataFrame, parts: list[DataFrame], c: SnapshotConfig) -> DataFrame:
    """The spine with its parts. Users without rows get 0, but recencies one more than the window and 1 for never."""
    out = reduce(lambda a, b: a.join(b, "user_id", "left"), parts, spine)
    absent = {f"days_since_last_{e}_{c.recency}d": c.recency + 1 for e in P.EVENTS} | {f"never_{e}_{c.recency}d": 1 for e in P.EVENTS}
    # nulls come from users without rows alone: parts have none
    filled = [(f.name, f"coalesce({f.name}, cast({absent.get(f.name, 0)} as {f.dataType.simpleString()}))") for f in out.schema if f.name != "user_id"]
    return out.selectExpr("user_id", *named(filled))


def raw(panel: DataFrame, c: SnapshotConfig, spine: DataFrame | None = None) -> DataFrame:
    """All base columns for each user of the spine (that of the panel if none is given)."""
    h = history(panel, c)
    by_event = _aggregate(event_days(h), P.gaps(c, PERCENTILE) + P.streaks(c))
    return zero_filled(spine if spine is not None else users_of(panel), [base(h, c), last_orders(h, c), by_event], c)


def derived(family: str, c: SnapshotConfig) -> list[str]:
    return named(P.DERIVED[family](c))


def snapshot(panel: DataFrame, c: SnapshotConfig, with_target: bool = True, spine: DataFrame | None = None) -> DataFrame:
    """user_id, cutoff_date, target and all features. Square sums serve the deviations only and are left out."""
    rows = raw(panel, c, spine)
    inner = {name for name, _ in P.window_squares(c)}
    first = [name for name in rows.columns if name not in inner and name not in ("user_id", "target")]
    families = [x for family in P.DERIVED for x in derived(family, c)]
    head = ["user_id", f"cast('{c.cutoff}' as date) as cutoff_date", *(["target"] if with_target else [])]
    return rows.selectExpr(*head, *first, *families)


def feature_names(c: SnapshotConfig) -> list[str]:
    """All features of snapshot(), in order."""
    texts = [
        *P.window_sums(c), *P.window_maxima(c), *P.blocks(c), *P.recency(c), *P.distinct_periods(c, DISTINCT), *P.weekends(c), *P.last_order_day(c), *P.order_day_money(c, PERCENTILE),
        *P.phases(c), *P.decays(c), *P.last_orders(c), *P.after_last_order(c), *P.gaps(c, PERCENTILE), *P.streaks(c),
    ]
    return [name for name, _ in texts] + [name for family in P.DERIVED.values() for name, _ in family(c)]


def narrowed(rows: DataFrame) -> DataFrame:
    """Doubles as floats, for storage; infinite and undefined values become 0."""
    kinds = {f.name: f.dataType for f in rows.schema}
    ok = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
    return rows.select(*[ok(F.col(n)).cast(FloatType()).alias(n) if isinstance(t, DoubleType) and n != "target" else F.col(n) for n, t in kinds.items()])


def cutoffs(start: str, end: str, step_days: int = 7, last: str | None = None) -> list[str]:
    """A schedule of cutoffs, with one appended if it isn't there."""
    from datetime import date, timedelta

    day, until, out = date.fromisoformat(start), date.fromisoformat(end), []
    while day <= until:
        out.append(day.isoformat())
        day += timedelta(days=step_days)
    return out + ([last] if last and last not in out else [])
