"""Feature definitions of the classic snapshot, as SQL text over the flagged history.

The history has one row per user and day with ``d``, the days before the cutoff (below 0: after it), the panel's values,
day flags (0 or 1), ``week``, ``month``, ``weekend`` and ``phase``. A definition is a pair of name and SQL text. Names follow
from the configuration, so one plan serves any set of windows.
"""

from __future__ import annotations

from tidemark.functions.expr import above_zero, change, ratio
from tidemark.plans.config import SnapshotConfig

Definitions = list[tuple[str, str]]

#: Day flags by name: when a day counts as one of the kind.
DAY_FLAGS: Definitions = [
    ("search_day", "search > 0"),
    ("cat_day", "cat > 0"),
    ("order_day", "to_ord > 0"),
    ("cart_day", "to_cart > 0"),
    ("search_to_cart_day", "has_search_to_cart > 0"),
    ("search_to_order_day", "has_search_to_ord > 0"),
    ("cat_to_cart_day", "has_cat_to_cart > 0"),
    ("cat_to_order_day", "has_cat_to_ord > 0"),
    ("active_day", "search > 0 or cat > 0 or to_cart > 0 or to_ord > 0 or searches > 0"),
    ("search_and_cat_day", "search > 0 and cat > 0"),
    ("cart_without_order_day", "to_cart > 0 and not to_ord > 0"),
    ("active_without_order_day", "(search > 0 or cat > 0 or to_cart > 0 or searches > 0) and not to_ord > 0"),
]

#: Names of the window sums, and what they add up.
SUMS = {
    "gmv": "gmv", "gmv_search": "gmv_search", "gmv_cat": "gmv_cat",
    "items_bought": "to_ord", "search_items_bought": "search_to_ord", "cat_items_bought": "cat_to_ord",
    "items_added_to_cart": "to_cart", "search_items_added_to_cart": "search_to_cart", "cat_items_added_to_cart": "cat_to_cart",
    "searches": "searches", "recorded_days": "1",
    "active_days": "active_day", "order_days": "order_day", "cart_days": "cart_day", "search_days": "search_day", "cat_days": "cat_day",
    "search_and_cat_days": "search_and_cat_day", "search_to_cart_days": "search_to_cart_day", "search_to_order_days": "search_to_order_day",
    "cat_to_cart_days": "cat_to_cart_day", "cat_to_order_days": "cat_to_order_day",
    "cart_without_order_days": "cart_without_order_day", "active_without_order_days": "active_without_order_day",
}
SQUARES = {"gmv_square_sum": "gmv", "items_bought_square_sum": "to_ord", "searches_square_sum": "searches"}
MAXIMA = {"max_daily_gmv": "gmv", "max_daily_items_bought": "to_ord", "max_daily_items_added_to_cart": "to_cart", "max_daily_searches": "searches"}
#: The metrics that blocks and nested trends are made of.
METRICS = ("gmv", "items_bought", "order_days", "items_added_to_cart", "searches", "active_days")
#: Events whose recency is kept, with their day flags.
EVENTS = {
    "activity": "active_day", "order": "order_day", "cart": "cart_day", "search": "search_day", "cat": "cat_day",
    "search_cart": "search_to_cart_day", "search_order": "search_to_order_day", "cat_cart": "cat_to_cart_day", "cat_order": "cat_to_order_day",
}
#: Events whose gaps and streaks are kept.
REGULAR = ("activity", "order", "cart")
PHASES = ("1_7", "8_15", "16_23", "24_end")
DECAYED = {"gmv": "gmv", "items_bought": "to_ord", "items_added_to_cart": "to_cart", "searches": "searches", "activity": "active_day"}
MONEY = {"gmv", "gmv_search", "gmv_cat"}


def _sum(of: str, where: str) -> str:
    kind = "double" if of in MONEY else "bigint"
    return f"cast(coalesce(sum({of}) filter (where {where}), 0) as {kind})"


def window_sums(c: SnapshotConfig) -> Definitions:
    return [(f"{name}_{n}d", _sum(of, f"d >= 0 and d < {n}")) for n in c.windows for name, of in SUMS.items()]


def window_squares(c: SnapshotConfig) -> Definitions:
    return [(f"{name}_{n}d", f"coalesce(sum(cast({of} as double) * {of}) filter (where d >= 0 and d < {n}), 0e0)") for n in c.windows for name, of in SQUARES.items()]


def window_maxima(c: SnapshotConfig) -> Definitions:
    return [(f"{name}_{n}d", f"cast(coalesce(max({of}) filter (where d >= 0 and d < {n}), 0) as {'double' if of in MONEY else 'bigint'})") for n in c.windows for name, of in MAXIMA.items()]


def target(c: SnapshotConfig) -> Definitions:
    return [("target", _sum("gmv", f"d < 0 and d >= -{c.horizon}"))]


def blocks(c: SnapshotConfig) -> Definitions:
    return [(f"{m}_block_{k}_{c.block_days}d", _sum(SUMS[m], f"d >= {k * c.block_days} and d < {(k + 1) * c.block_days}")) for m in METRICS for k in range(c.blocks)]


def recency(c: SnapshotConfig) -> Definitions:
    out: Definitions = []
    for event, flag in EVENTS.items():
        on = f"filter (where {flag} = 1 and d >= 0)"
        out += [
            (f"days_since_last_{event}_{c.recency}d", f"cast(coalesce(min(d) {on}, {c.recency + 1}) as bigint)"),
            (f"days_since_first_{event}_{c.recency}d", f"cast(coalesce(max(d) {on}, 0) as bigint)"),
            (f"{event}_span_{c.recency}d", f"cast(coalesce(max(d) {on} - min(d) {on}, 0) as bigint)"),
            (f"never_{event}_{c.recency}d", f"cast(case when count(*) {on} = 0 then 1 else 0 end as bigint)"),
        ]
    return out


def distinct_periods(c: SnapshotConfig, distinct: str) -> Definitions:
    """distinct: how the engine counts distinct values of {x}."""
    some = [("week", e) for e in ("activity", "order", "cart", "search")] + [("month", e) for e in ("activity", "order")]
    return [(f"{e}_{period}s_{c.recency}d", f"cast({distinct.format(x=f'case when {EVENTS[e]} = 1 and d >= 0 then {period} end')} as bigint)") for period, e in some]


def weekends(c: SnapshotConfig) -> Definitions:
    return [(f"weekend_{m}_{n}d", _sum(SUMS[m], f"d >= 0 and d < {n} and weekend = 1")) for n in c.weekend_windows for m in ("gmv", "items_bought", "active_days")]


def last_order_day(c: SnapshotConfig) -> Definitions:
    of = {"gmv": "gmv", "gmv_search": "gmv_search", "gmv_cat": "gmv_cat", "items_bought": "to_ord"}
    return [(f"last_order_day_{n}_{c.recency}d", f"cast(coalesce(min_by({x}, d) filter (where order_day = 1 and d >= 0), 0) as {'double' if x in MONEY else 'bigint'})") for n, x in of.items()]


def order_day_money(c: SnapshotConfig, percentile: str) -> Definitions:
    own = "case when order_day = 1 and d >= 0 then gmv end"
    return [
        (f"order_day_gmv_median_{c.recency}d", f"coalesce({percentile.format(x=own, q='0.5')}, 0e0)"),
        (f"order_day_gmv_mean_{c.recency}d", f"coalesce(avg({own}), 0e0)"),
        (f"order_day_gmv_std_{c.recency}d", f"coalesce(stddev_samp({own}), 0e0)"),
    ]


def phases(c: SnapshotConfig) -> Definitions:
    return [(f"order_days_month_phase_{p}_{c.recency}d", _sum("order_day", f"d >= 0 and phase = '{p}'")) for p in PHASES] + [(f"gmv_month_phase_{p}_{c.recency}d", _sum("gmv", f"d >= 0 and phase = '{p}'")) for p in PHASES]


def decays(c: SnapshotConfig) -> Definitions:
    return [(f"decay_{m}_halflife_{h}d", f"coalesce(sum({of} * power(0.5e0, d / {h}e0)) filter (where d >= 0), 0e0)") for m, of in DECAYED.items() for h in c.half_lives]


#: Over rows with ``order_rank`` (1: the last order day) and ``last_order`` (its d).
def last_orders(c: SnapshotConfig) -> Definitions:
    return [(f"last_{k}_order_day_{n}_{c.recency}d", _sum(of, f"order_day = 1 and d >= 0 and order_rank = {k}")) for n, of in (("gmv", "gmv"), ("items_bought", "to_ord")) for k in (1, 2, 3)]


def after_last_order(c: SnapshotConfig) -> Definitions:
    return [(f"{n}_after_last_order_{c.recency}d", _sum(SUMS[n], "d >= 0 and d < last_order")) for n in ("searches", "items_added_to_cart", "search_days", "cart_days", "active_days")]


def gaps(c: SnapshotConfig, percentile: str) -> Definitions:
    """Over long rows (user_id, event, d, gap): gap is the days since the event's day before, null for its first."""
    out: Definitions = []
    for e in REGULAR:
        own = f"case when event = '{e}' then gap end"
        out += [
            (f"{e}_gap_mean_{c.recency}d", f"coalesce(avg({own}), 0e0)"),
            (f"{e}_gap_median_{c.recency}d", f"coalesce({percentile.format(x=own, q='0.5')}, 0e0)"),
            (f"{e}_gap_std_{c.recency}d", f"coalesce(stddev_samp({own}), 0e0)"),
            (f"{e}_gap_max_{c.recency}d", f"cast(coalesce(max({own}), 0) as bigint)"),
            (f"{e}_gap_last_{c.recency}d", f"cast(coalesce(min_by(gap, d) filter (where event = '{e}' and gap is not null), 0) as bigint)"),
        ]
    own = "case when event = 'order' then gap end"
    return out + [(f"order_gap_q{q}_{c.recency}d", f"coalesce({percentile.format(x=own, q=f'0.{q}')}, 0e0)") for q in (25, 75, 90)]


def streaks(c: SnapshotConfig) -> Definitions:
    """Over rows (user_id, event, length): one for each run of consecutive days, or more that lead up to it."""
    return [(f"{e}_longest_streak_{c.recency}d", f"cast(coalesce(max(length) filter (where event = '{e}'), 0) as bigint)") for e in REGULAR]


# --- derived features: over the columns above -----------------------------------------------------------------------


def window_ratios(c: SnapshotConfig) -> Definitions:
    out: Definitions = []
    for n in c.windows:
        v = lambda name: f"{name}_{n}d"  # noqa: B023, E731
        pairs = [
            ("gmv_per_item", "gmv", "items_bought"), ("gmv_per_order_day", "gmv", "order_days"), ("items_per_order_day", "items_bought", "order_days"),
            ("items_per_active_day", "items_bought", "active_days"), ("cart_to_order_conversion", "items_bought", "items_added_to_cart"),
            ("search_cart_to_order_conversion", "search_items_bought", "search_items_added_to_cart"), ("cat_cart_to_order_conversion", "cat_items_bought", "cat_items_added_to_cart"),
            ("search_query_to_cart_conversion", "search_items_added_to_cart", "searches"), ("search_query_to_order_conversion", "search_items_bought", "searches"),
            ("searches_per_search_day", "searches", "search_days"), ("order_days_per_active_day", "order_days", "active_days"),
            ("active_without_order_share", "active_without_order_days", "active_days"), ("cart_without_order_share", "cart_without_order_days", "cart_days"),
            ("search_gmv_share", "gmv_search", "gmv"), ("search_items_share", "search_items_bought", "items_bought"), ("search_cart_share", "search_items_added_to_cart", "items_added_to_cart"),
        ]
        out += [(v(name), ratio(v(a), v(b))) for name, a, b in pairs]
        out.append((v("recorded_zero_days"), above_zero(f"{v('recorded_days')} - {v('active_days')}")))
    return out


def volatility(c: SnapshotConfig) -> Definitions:
    """Over the N calendar days of a window; days without a row count as zeros."""
    out: Definitions = []
    for n in c.windows:
        std = lambda squares, total: f"sqrt(greatest({squares}_{n}d / {n} - power({total}_{n}d / {n}e0, 2), 0))"  # noqa: B023, E731
        out += [
            (f"daily_gmv_std_{n}d", std("gmv_square_sum", "gmv")),
            (f"daily_gmv_cv_{n}d", ratio(std("gmv_square_sum", "gmv"), f"gmv_{n}d / {n} + 1")),
            (f"daily_items_bought_std_{n}d", std("items_bought_square_sum", "items_bought")),
            (f"daily_searches_std_{n}d", std("searches_square_sum", "searches")),
            (f"max_daily_gmv_share_{n}d", ratio(f"max_daily_gmv_{n}d", f"gmv_{n}d")),
        ]
    return out


def weekend_shares(c: SnapshotConfig) -> Definitions:
    names = (("weekend_gmv_share", "gmv"), ("weekend_items_share", "items_bought"), ("weekend_activity_share", "active_days"))
    return [(f"{name}_{n}d", ratio(f"weekend_{m}_{n}d", f"{m}_{n}d")) for n in c.weekend_windows for name, m in names]


def nested_trends(c: SnapshotConfig) -> Definitions:
    out: Definitions = []
    older = c.long - c.short
    for m in METRICS:
        for recent, wide in c.nested:
            out.append((f"{m}_trend_{recent}_vs_previous_{recent}", change(f"{m}_{recent}d", above_zero(f"{m}_{wide}d - {m}_{recent}d"))))
        out.append((f"{m}_recent_{c.short}_share_{c.long}", ratio(f"{m}_{c.short}d", f"{m}_{c.long}d")))
        out.append((f"{m}_rate_trend_{c.short}_vs_older_{older}", change(f"{m}_{c.short}d / {c.short}e0", f"{above_zero(f'{m}_{c.long}d - {m}_{c.short}d')} / {older}e0")))
    return out


def smoothed_trends(c: SnapshotConfig) -> Definitions:
    recent = [r for r, _ in c.nested if r >= c.short and r < c.long] or [c.short]
    return [(f"{name}_trend_{r}_{c.long}", ratio(f"{m}_{r}d + 1", f"{m}_{c.long}d * {r}e0 / {c.long}e0 + 1")) for r in recent for name, m in (("items", "items_bought"), ("gmv", "gmv"))]


def channel_changes(c: SnapshotConfig) -> Definitions:
    s, n = c.short, c.long
    pairs = (("search_gmv_share", "gmv_search", "gmv"), ("cart_to_order_conversion", "items_bought", "items_added_to_cart"), ("search_conversion", "search_items_bought", "search_items_added_to_cart"), ("cat_conversion", "cat_items_bought", "cat_items_added_to_cart"))
    out = [(f"{name}_change_{s}_vs_{n}", f"{ratio(f'{a}_{s}d', f'{b}_{s}d')} - {ratio(f'{a}_{n}d', f'{b}_{n}d')}") for name, a, b in pairs]
    by = {name: ratio(f"{a}_{s}d", f"{b}_{s}d") for name, a, b in pairs}
    return [*out, (f"channel_conversion_gap_{s}d", f"{by['search_conversion']} - {by['cat_conversion']}")]


def burstiness(c: SnapshotConfig) -> Definitions:
    out: Definitions = []
    for e in REGULAR:
        mean, std = f"{e}_gap_mean_{c.recency}d", f"{e}_gap_std_{c.recency}d"
        out += [(f"{e}_gap_cv_{c.recency}d", ratio(std, f"{mean} + 1")), (f"{e}_burstiness_{c.recency}d", f"({std} - {mean}) / ({std} + {mean} + 1)")]
    return out


def purchase_cycle(c: SnapshotConfig) -> Definitions:
    r = f"{c.recency}d"
    since, median, days = f"days_since_last_order_{r}", f"order_gap_median_{r}", f"order_days_{r}"
    valid, single = f"(case when {days} >= 2 then 1 else 0 end)", f"(case when {days} = 1 then 1 else 0 end)"
    overdue = f"({above_zero(f'{since} - {median}')} * {valid})"
    out = [
        ("has_valid_order_gap", valid), ("has_single_order", single), ("days_since_only_order", f"{since} * {single}"), ("single_order_gmv", f"gmv_{r} * {single}"),
        ("order_overdue_ratio", f"{ratio(since, f'{median} + 1')} * {valid}"), ("order_days_to_expected", f"({median} - {since}) * {valid}"), ("order_overdue_days", overdue),
        ("order_expected_within_30d", f"case when {since} + 30 >= {median} then {valid} else 0 end"), ("order_cycle_phase", f"least({ratio(since, f'{median} + 1')}, 5) * {valid}"),
        ("order_last_gap_to_median", f"{ratio(f'order_gap_last_{r}', f'{median} + 1')} * {valid}"), ("order_last_gap_to_mean", f"{ratio(f'order_gap_last_{r}', f'order_gap_mean_{r} + 1')} * {valid}"),
        ("order_gap_iqr", f"{above_zero(f'order_gap_q75_{r} - order_gap_q25_{r}')} * {valid}"), ("order_gap_q90_to_median", f"{ratio(f'order_gap_q90_{r}', f'{median} + 1')} * {valid}"),
        ("expected_orders_next_30d", f"{ratio('30', f'{median} + 1')} * {valid}"), ("expected_orders_next_30d_with_overdue", f"{ratio(f'30 + {overdue}', f'{median} + 1')} * {valid}"),
    ]
    return [(f"{name}_{r}", text) for name, text in out]


def last_order_trends(c: SnapshotConfig) -> Definitions:
    r = f"{c.recency}d"
    last, before, ordered = f"last_1_order_day_gmv_{r}", f"((last_2_order_day_gmv_{r} + last_3_order_day_gmv_{r}) / 2)", f"(1 - never_order_{r})"
    days = f"days_since_last_order_{r} + 1"
    return [
        (f"last_order_gmv_to_previous_two_mean_{r}", f"{ratio(last, f'{before} + 1')} * {ordered}"),
        (f"last_order_gmv_trend_vs_previous_two_{r}", f"{change(last, before)} * {ordered}"),
        (f"searches_after_last_order_per_day_{r}", f"{ratio(f'searches_after_last_order_{r}', days)} * {ordered}"),
        (f"cart_items_after_last_order_per_day_{r}", f"{ratio(f'items_added_to_cart_after_last_order_{r}', days)} * {ordered}"),
        (f"active_share_after_last_order_{r}", f"{ratio(f'active_days_after_last_order_{r}', days)} * {ordered}"),
        (f"has_search_after_last_order_{r}", f"case when search_days_after_last_order_{r} > 0 then {ordered} else 0 end"),
        (f"has_cart_after_last_order_{r}", f"case when cart_days_after_last_order_{r} > 0 then {ordered} else 0 end"),
    ]


def phase_shares(c: SnapshotConfig) -> Definitions:
    r = f"{c.recency}d"
    return [x for p in PHASES for x in ((f"order_days_month_phase_{p}_share_{r}", ratio(f"order_days_month_phase_{p}_{r}", f"order_days_{r}")), (f"gmv_month_phase_{p}_share_{r}", ratio(f"gmv_month_phase_{p}_{r}", f"gmv_{r}")))]


def rfm(c: SnapshotConfig) -> Definitions:
    r = f"{c.recency}d"
    days, age, since = f"order_days_{r}", f"days_since_first_order_{r}", f"days_since_last_order_{r}"
    return [
        (f"is_seen_{r}", f"1 - never_activity_{r}"), (f"btyd_frequency_{r}", above_zero(f"{days} - 1")), (f"btyd_recency_{r}", f"order_span_{r}"), (f"btyd_T_{r}", age),
        (f"order_frequency_per_age_{r}", ratio(days, f"{age} + 1")), (f"order_recency_to_age_{r}", ratio(since, f"{age} + 1")), (f"order_frequency_per_recency_{r}", ratio(days, f"{since} + 1")),
    ]


def intents(c: SnapshotConfig) -> Definitions:
    s, n = c.short, c.long
    return [
        (f"engaged_nonbuyer_{s}d", f"case when active_days_{s}d > 0 and order_days_{s}d = 0 then 1 else 0 end"),
        (f"recent_cart_without_order_{s}d", f"case when cart_days_{s}d > 0 and order_days_{s}d = 0 then 1 else 0 end"),
        (f"expected_gmv_from_recent_cart_{s}d", f"items_added_to_cart_{s}d * {ratio(f'items_bought_{n}d', f'items_added_to_cart_{n}d')} * {ratio(f'gmv_{n}d', f'items_bought_{n}d')}"),
        (f"search_intent_value_{s}d", f"searches_{s}d * {ratio(f'search_items_bought_{n}d', f'searches_{n}d')} * {ratio(f'gmv_search_{n}d', f'search_items_bought_{n}d')}"),
    ]


def block_statistics(c: SnapshotConfig) -> Definitions:
    """Shape of the blocks: block 0 is the latest. Deviations are those of a population."""
    out: Definitions = []
    n = c.blocks
    weight = [0.75**k for k in range(n)]
    slope = [n // 2 - k for k in range(n)]
    for m in METRICS:
        b = [f"{m}_block_{k}_{c.block_days}d" for k in range(n)]
        total = "(" + " + ".join(b) + ")"
        mean = f"({total} / {n}e0)"
        some = "(" + " + ".join(f"(case when {x} > 0 then 1 else 0 end)" for x in b) + ")"
        run = "case " + " ".join(f"when {x} > 0 then {k}" for k, x in enumerate(b)) + f" else {n} end"
        out += [
            (f"{m}_block_mean", mean),
            (f"{m}_block_std", "sqrt((" + " + ".join(f"power({x} - {mean}, 2)" for x in b) + f") / {n}e0)"),
            (f"{m}_block_min", f"least({', '.join(b)})"),
            (f"{m}_block_max", f"greatest({', '.join(b)})"),
            (f"{m}_nonzero_blocks", some),
            (f"{m}_zero_block_share", f"1 - {some} / {n}e0"),
            (f"{m}_positive_block_mean", f"{total} / cast(greatest({some}, 1) as double)"),
            (f"{m}_block_slope", "(" + " + ".join(f"{w} * {x}" for w, x in zip(slope, b, strict=True)) + f") / {sum(w * w for w in slope)}e0"),
            (f"{m}_block_ewm", "(" + " + ".join(f"{w!r}e0 * {x}" for w, x in zip(weight, b, strict=True)) + f") / {sum(weight)!r}e0"),
            (f"{m}_recent_to_block_mean", f"({b[0]} + 1) / ({mean} + 1)"),
            (f"{m}_recent_zero_block_run", run),
        ]
    return out


#: Families of derived features, each over the columns of the base and of no other family.
DERIVED = {
    "window_ratios": window_ratios,
    "calendar_std": volatility,
    "weekend_shares": weekend_shares,
    "nested_trends": nested_trends,
    "smoothed_trends": smoothed_trends,
    "channel_change": channel_changes,
    "burstiness": burstiness,
    "purchase_cycle": purchase_cycle,
    "last_order_trend": last_order_trends,
    "phase_shares": phase_shares,
    "rfm_btyd_stats": rfm,
    "intent_features": intents,
    "block_stats": block_statistics,
}
