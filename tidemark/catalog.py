"""All queries of the activity-panel library, with the SQL that checks them.

Floating results are rounded to six decimals on both sides, since engines add doubles in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import sequence as S
from tidemark.operators import snapshot as N
from tidemark.plans import by_hand as H
from tidemark.plans import features as P
from tidemark.plans import oracle as O
from tidemark.plans.config import EVENTS, EVENTS_SEQUENCE, ORDERS, ORDERS_SEQUENCE, SnapshotConfig
from tidemark.sources.panel import events_panel, orders_panel

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_panel(_read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_panel(_read(spark, sf_dir, "events"))


PANELS = {"orders": (orders, O.ORDERS_PANEL), "events": (events, O.EVENTS_PANEL)}


def rounded(df: DataFrame, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """All columns but keys as doubles of six decimals."""
    return df.selectExpr(*keys, *[f"round(cast({c} as double), 6) + 0.0D as {c}" for c in df.columns if c not in keys])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.snapshot(orders(spark, sf_dir), ORDERS), ("user_id", "cutoff_date"))


def _names(*texts: P.Definitions) -> list[str]:
    return [name for t in texts for name, _ in t]


def _base_families(c: SnapshotConfig) -> dict[str, tuple[str, list[str]]]:
    """Families of base columns: the part of the plan that they come from, and their names."""
    regular = _names(P.gaps(c, ""))
    return {
        "window_aggs": ("base", _names(P.window_sums(c))),
        "window_max": ("base", _names(P.window_maxima(c))),
        f"target_{c.horizon}d": ("base", ["target"]),
        f"blocks_{c.block_days}d": ("base", _names(P.blocks(c))),
        "recency_by_event": ("base", _names(P.recency(c))),
        "active_weeks_months": ("base", _names(P.distinct_periods(c, ""))),
        "weekend_aggs": ("base", _names(P.weekends(c))),
        "last_order_day": ("base", _names(P.last_order_day(c))),
        "order_day_gmv_dist": ("base", _names(P.order_day_money(c, ""))),
        "month_phase_crosstab": ("base", _names(P.phases(c)[:4])),
        "month_phase_gmv_pivot": ("base", _names(P.phases(c)[4:])),
        "decay_sums": ("base", _names(P.decays(c))),
        "last3_order_days": ("last_orders", _names(P.last_orders(c))),
        "after_last_order": ("last_orders", _names(P.after_last_order(c))),
        "gap_stats": ("gaps", regular[: 5 * len(P.REGULAR)]),
        "order_gap_quantiles": ("gaps", regular[5 * len(P.REGULAR) :]),
        "longest_streak": ("streaks", _names(P.streaks(c))),
    }


def _base_query(part: str, names: list[str], panel: str, c: SnapshotConfig) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = PANELS[panel][0](spark, sf_dir)
        own = getattr(N, part)(N.history(rows, c), c).select("user_id", *names)
        return rounded(N.zero_filled(N.users_of(rows), [own], c))

    return run


def _derived_query(family: str, c: SnapshotConfig) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = N.raw(orders(spark, sf_dir), c)
        return rounded(rows.selectExpr("user_id", *N.derived(family, c)))

    return run


def _sequence_query(family: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = S.cutoff_state_rows(S.sequence_days(orders(spark, sf_dir), ORDERS_SEQUENCE), ORDERS_SEQUENCE)
        out = S.features(rows, ORDERS_SEQUENCE, (family,))
        return rounded(out.select("user_id", "day_index", *[n for n, _ in S.family_texts(family, ORDERS_SEQUENCE)]), ("user_id", "day_index"))

    return run


def panel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir)


def panel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir)


def daily_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.add_flags(events(spark, sf_dir))


def user_spine_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer of the customer table, with or without orders: the spine is wider than the panel."""
    spine = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id"))
    rows = orders(spark, sf_dir)
    names = ["gmv_270d", "days_since_last_order_270d", "never_order_270d"]
    return rounded(N.zero_filled(spine, [N.base(N.history(rows, ORDERS), ORDERS).select("user_id", *names)], ORDERS))


def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.snapshot(events(spark, sf_dir), EVENTS), ("user_id", "cutoff_date"))


def sequence_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.sequence_days(orders(spark, sf_dir), ORDERS_SEQUENCE), ("user_id", "event_date", "day_index"))


def cutoff_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.cutoff_state_rows(S.sequence_days(events(spark, sf_dir), EVENTS_SEQUENCE), EVENTS_SEQUENCE)
    return rounded(rows, ("user_id", "event_date", "day_index", "cutoff_state_row"))


def sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.sequence_features(events(spark, sf_dir), EVENTS_SEQUENCE)
    names = [n for f in S.FAMILIES for n, _ in S.family_texts(f, EVENTS_SEQUENCE)]
    return rounded(out.select("user_id", "day_index", *names), ("user_id", "day_index"))


def dense_tensor_180(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.cutoff_state_rows(S.sequence_days(orders(spark, sf_dir), ORDERS_SEQUENCE), ORDERS_SEQUENCE)
    return S.dense(rows, list(S.VALUES), ORDERS_SEQUENCE)


def _own() -> dict[str, tuple[Query, str | None]]:
    """Name, query and checking SQL (None where a test against brute force stands in)."""
    spine_sql = O.filled_ctes(O.ORDERS_PANEL, ORDERS) + """
select c.c_custkey user_id, round(cast(coalesce(gmv_270d, 0) as double), 6) gmv_270d, cast(coalesce(days_since_last_order_270d, 271) as double) days_since_last_order_270d, cast(coalesce(never_order_270d, 1) as double) never_order_270d
from customer c left join filled f on c.c_custkey = f.user_id"""
    out: dict[str, tuple[Query, str | None]] = {
        "panel_orders": (panel_orders, f"with {O.ORDERS_PANEL}\nselect {O.COLUMNS} from panel"),
        "panel_events": (panel_events, f"with {O.EVENTS_PANEL}\nselect {O.COLUMNS} from panel"),
        "daily_flags": (daily_flags, O.flags_sql(O.EVENTS_PANEL)),
        "user_spine_zero_fill": (user_spine_zero_fill, spine_sql),
        "classic_snapshot": (flagship, O.snapshot_sql(O.ORDERS_PANEL, ORDERS, N.feature_names(ORDERS))),
        "snapshot_events": (snapshot_events, O.snapshot_sql(O.EVENTS_PANEL, EVENTS, N.feature_names(EVENTS))),
        "sequence_days": (sequence_days, O.sequence_days_sql(O.ORDERS_PANEL, ORDERS_SEQUENCE)),
        "cutoff_state_rows": (cutoff_state_rows, O.state_rows_sql(O.EVENTS_PANEL, EVENTS_SEQUENCE)),
        "sequence_features": (sequence_features, O.sequence_sql(O.EVENTS_PANEL, EVENTS_SEQUENCE, tuple(S.FAMILIES))),
        "dense_tensor_180": (dense_tensor_180, None),
    }
    for name, (part, names) in _base_families(ORDERS).items():
        out[name] = (_base_query(part, names, "orders", ORDERS), O.base_sql(O.ORDERS_PANEL, ORDERS, names))
    by_hand = H.families(O.ORDERS_PANEL, ORDERS.cutoff, ORDERS.windows)
    for family in P.DERIVED:
        name = {"window_ratios": "ratios_window"}.get(family, family)
        out[name] = (_derived_query(family, ORDERS), by_hand[family])
    for family in S.FAMILIES:
        out[family] = (_sequence_query(family), O.sequence_sql(O.ORDERS_PANEL, ORDERS_SEQUENCE, (family,)))
    return out


def _all() -> dict[str, tuple[Query, str | None]]:
    from tidemark import scoring_catalog

    return _own() | scoring_catalog.entries()


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
