"""The derived families of the default snapshot as DuckDB SQL of their own, for checking.

Nothing here is made from the definitions in ``features``: windows are rows instead of columns, previous windows are day
ranges of their own, deviations run over a calendar with its empty days, blocks are statistics of nine rows (the slope is a
regression), and gaps come from the list of a user's days. Only the panel is shared.
"""

from __future__ import annotations

METRICS = ("gmv", "items_bought", "order_days", "items_added_to_cart", "searches", "active_days")


def _days(panel: str, cutoff: str) -> str:
    return f"""with {panel},
users as (select distinct user_id from panel),
days as (
    select user_id, event_date, date_diff('day', event_date, date '{cutoff}') as d, gmv, gmv_search, gmv_cat, searches,
        to_ord as items_bought, search_to_ord as search_items, cat_to_ord as cat_items,
        to_cart as items_added_to_cart, search_to_cart as search_cart, cat_to_cart as cat_cart,
        (to_ord > 0)::int as order_days, (to_cart > 0)::int as cart_days, (search > 0)::int as search_days,
        (search > 0 or cat > 0 or to_cart > 0 or to_ord > 0 or searches > 0)::int as active_days,
        (to_ord <= 0 and (search > 0 or cat > 0 or to_cart > 0 or searches > 0))::int as idle_days, (to_cart > 0 and to_ord <= 0)::int as left_carts
    from panel where event_date between date '{cutoff}' - 269 and date '{cutoff}'
)"""


_SUMMED = ("gmv", "gmv_search", "gmv_cat", "searches", "items_bought", "search_items", "cat_items", "items_added_to_cart", "search_cart", "cat_cart", "order_days", "cart_days", "search_days", "active_days", "idle_days", "left_carts")


def _windows(windows: tuple[int, ...]) -> str:
    sums = ", ".join(f"coalesce(sum({x}), 0)::double as {x}" for x in _SUMMED)
    return f""",
wide as (
    select users.user_id, n, {sums}, count(d)::double as recorded_days, coalesce(max(gmv), 0)::double as top_gmv
    from users cross join (values {", ".join(f"({n})" for n in windows)}) as w(n) left join days on days.user_id = users.user_id and d < n
    group by all
)"""


def _share(a: str, b: str) -> str:
    return f"case when {b} = 0 then 0 else {a} / {b} end"


def _turned(rows: str, by: str, values: dict[str, tuple[str, object]]) -> str:
    """One row a user from one row a user and key: each column with the expression and the key's value that it comes from."""
    columns = ", ".join(f"round(max(case when {by} = {key!r} then {x} end)::double, 6) + 0e0 as {name}" for name, (x, key) in values.items())
    return f"\nselect user_id, {columns} from {rows} group by user_id"


def window_ratios(panel: str, cutoff: str, windows: tuple[int, ...]) -> str:
    shares = {
        "gmv_per_item": _share("gmv", "items_bought"), "gmv_per_order_day": _share("gmv", "order_days"), "items_per_order_day": _share("items_bought", "order_days"),
        "items_per_active_day": _share("items_bought", "active_days"), "cart_to_order_conversion": _share("items_bought", "items_added_to_cart"),
        "search_cart_to_order_conversion": _share("search_items", "search_cart"), "cat_cart_to_order_conversion": _share("cat_items", "cat_cart"),
        "search_query_to_cart_conversion": _share("search_cart", "searches"), "search_query_to_order_conversion": _share("search_items", "searches"),
        "searches_per_search_day": _share("searches", "search_days"), "recorded_zero_days": "case when recorded_days > active_days then recorded_days - active_days else 0 end",
        "order_days_per_active_day": _share("order_days", "active_days"), "active_without_order_share": _share("idle_days", "active_days"), "cart_without_order_share": _share("left_carts", "cart_days"),
        "search_gmv_share": _share("gmv_search", "gmv"), "search_items_share": _share("search_items", "items_bought"), "search_cart_share": _share("search_cart", "items_added_to_cart"),
    }
    return _days(panel, cutoff) + _windows(windows) + _turned("wide", "n", {f"{name}_{n}d": (x, n) for n in windows for name, x in shares.items()})


def calendar_std(panel: str, cutoff: str, windows: tuple[int, ...]) -> str:
    own = {"daily_gmv_std": "s_gmv", "daily_gmv_cv": "s_gmv / (m_gmv + 1)", "daily_items_bought_std": "s_items", "daily_searches_std": "s_searches", "max_daily_gmv_share": _share("top", "total")}
    return _days(panel, cutoff) + f""",
calendar as (
    select users.user_id, t.d, coalesce(gmv, 0)::double as gmv, coalesce(items_bought, 0)::double as items, coalesce(searches, 0)::double as searches
    from users cross join range(270) as t(d) left join days on days.user_id = users.user_id and days.d = t.d
),
spread as (
    select user_id, n, stddev_pop(gmv) as s_gmv, avg(gmv) as m_gmv, stddev_pop(items) as s_items, stddev_pop(searches) as s_searches, max(gmv) as top, sum(gmv) as total
    from calendar join (values {", ".join(f"({n})" for n in windows)}) as w(n) on d < n group by all
)""" + _turned("spread", "n", {f"{name}_{n}d": (x, n) for n in windows for name, x in own.items()})


def _ranges(metric: str, low: int, high: int) -> str:
    """The sum of a metric over the days from low up to, and without, high before the cutoff."""
    return f"coalesce(sum({metric}) filter (where d >= {low} and d < {high}), 0)::double"


def _by_user(panel: str, cutoff: str, columns: dict[str, str]) -> str:
    texts = ", ".join(f"round(({x})::double, 6) + 0e0 as {name}" for name, x in columns.items())
    return _days(panel, cutoff) + f"\nselect users.user_id, {texts} from users left join days on days.user_id = users.user_id group by users.user_id"


def weekend_shares(panel: str, cutoff: str) -> str:
    own = {"weekend_gmv_share": "gmv", "weekend_items_share": "items_bought", "weekend_activity_share": "active_days"}
    return _by_user(panel, cutoff, {f"{name}_{n}d": f"coalesce(sum({m}) filter (where d < {n} and dayname(event_date) in ('Saturday', 'Sunday')) / nullif(sum({m}) filter (where d < {n}), 0), 0)" for name, m in own.items() for n in (90, 180, 270)})


def nested_trends(panel: str, cutoff: str) -> str:
    out = {}
    for m in METRICS:
        for n in (7, 30, 90):
            now, then = _ranges(m, 0, n), _ranges(m, n, 2 * n)
            out[f"{m}_trend_{n}_vs_previous_{n}"] = f"({now} - {then}) / (1 + {now} + {then})"  # no sum is negative
        now, then = _ranges(m, 0, 30), _ranges(m, 30, 180)
        out[f"{m}_recent_30_share_180"] = f"coalesce({now} / nullif({now} + {then}, 0), 0)"
        out[f"{m}_rate_trend_30_vs_older_150"] = f"({now} * 5 - {then}) / (150 + {now} * 5 + {then})"
    return _by_user(panel, cutoff, out)


def smoothed_trends(panel: str, cutoff: str) -> str:
    return _by_user(panel, cutoff, {f"{name}_trend_{n}_180": f"({_ranges(m, 0, n)} + 1) / ({_ranges(m, 0, 180)} / {180 // n} + 1)" for name, m in (("items", "items_bought"), ("gmv", "gmv")) for n in (30, 90)})


def channel_change(panel: str, cutoff: str) -> str:
    pairs = {"search_gmv_share": ("gmv_search", "gmv"), "cart_to_order_conversion": ("items_bought", "items_added_to_cart"), "search_conversion": ("search_items", "search_cart"), "cat_conversion": ("cat_items", "cat_cart")}
    of = lambda name, n: f"coalesce(sum({pairs[name][0]}) filter (where d < {n})::double / nullif(sum({pairs[name][1]}) filter (where d < {n}), 0), 0)"
    out = {f"{name}_change_30_vs_180": f"{of(name, 30)} - {of(name, 180)}" for name in pairs}
    return _by_user(panel, cutoff, out | {"channel_conversion_gap_30d": f"{of('search_conversion', 30)} - {of('cat_conversion', 30)}"})


def phase_shares(panel: str, cutoff: str) -> str:
    months = {"1_7": "day(event_date) < 8", "8_15": "day(event_date) between 8 and 15", "16_23": "day(event_date) between 16 and 23", "24_end": "day(event_date) > 23"}
    return _by_user(panel, cutoff, {f"{m}_month_phase_{p}_share_270d": f"coalesce(sum({m}) filter (where {when})::double / nullif(sum({m}), 0), 0)" for p, when in months.items() for m in ("order_days", "gmv")})


def intent_features(panel: str, cutoff: str) -> str:
    no_order = f"{_ranges('order_days', 0, 30)} = 0"
    half = lambda m: f"nullif({_ranges(m, 0, 180)}, 0)"
    return _by_user(panel, cutoff, {
        "engaged_nonbuyer_30d": f"({_ranges('active_days', 0, 30)} > 0 and {no_order})::int", "recent_cart_without_order_30d": f"({_ranges('cart_days', 0, 30)} > 0 and {no_order})::int",
        "expected_gmv_from_recent_cart_30d": f"coalesce({_ranges('items_added_to_cart', 0, 30)} * {half('gmv')} / {half('items_added_to_cart')} * ({half('items_bought')} / {half('items_bought')}), 0)",
        "search_intent_value_30d": f"coalesce({_ranges('searches', 0, 30)} * {half('gmv_search')} / {half('searches')} * ({half('search_items')} / {half('search_items')}), 0)",
    })


def _lists(panel: str, cutoff: str) -> str:
    """Each user's days of each event, latest first, and the gaps between them, latest first."""
    own = ", ".join(f"coalesce(list(d order by d) filter (where {flag} = 1), []) as {e}" for e, flag in (("activity", "active_days"), ("orders", "order_days"), ("cart", "cart_days")))
    gaps = ", ".join(f"list_transform(range(1, len({e})), lambda i: {e}[i + 1] - {e}[i]) as {e}_gaps" for e in ("activity", "orders", "cart"))
    return _days(panel, cutoff) + f""",
listed as (
    select users.user_id, {own}, coalesce(list(gmv::double order by d) filter (where order_days = 1), []) as paid, coalesce(sum(gmv), 0)::double as money
    from users left join days on days.user_id = users.user_id group by users.user_id
),
gapped as (select *, {gaps}, coalesce(orders[1], 271)::double as since, coalesce(orders[-1], 0)::double as age, len(orders) as n from listed),
told as (
    select *, coalesce(list_median(orders_gaps), 0)::double as usual, coalesce(list_avg(orders_gaps), 0)::double as mean,
        {", ".join(f"coalesce(list_aggregate(orders_gaps, 'quantile_cont', 0.{q}), 0)::double as q{q}" for q in (25, 75, 90))}
    from gapped
)"""


def _of_lists(panel: str, cutoff: str, columns: dict[str, str], rows: str = "told") -> str:
    return _lists(panel, cutoff) + "\nselect user_id, " + ", ".join(f"round(({x})::double, 6) + 0e0 as {name}_270d" for name, x in columns.items()) + f" from {rows}"


def burstiness(panel: str, cutoff: str) -> str:
    out = {}
    for name, e in (("activity", "activity"), ("order", "orders"), ("cart", "cart")):
        mean, std = f"coalesce(list_avg({e}_gaps), 0)", f"coalesce(list_stddev_samp({e}_gaps), 0)"
        out |= {f"{name}_gap_cv": f"{std} / (1 + {mean})", f"{name}_burstiness": f"({std} - {mean}) / (1 + {std} + {mean})"}
    return _of_lists(panel, cutoff, out)


def purchase_cycle(panel: str, cutoff: str) -> str:
    regular = {
        "order_overdue_ratio": "since / (1 + usual)", "order_days_to_expected": "usual - since", "order_overdue_days": "case when since > usual then since - usual else 0 end",
        "order_expected_within_30d": "(usual - since <= 30)::int", "order_cycle_phase": "case when since > 5 * (1 + usual) then 5 else since / (1 + usual) end",
        "order_last_gap_to_median": "orders_gaps[1] / (1 + usual)", "order_last_gap_to_mean": "orders_gaps[1] / (1 + mean)", "order_gap_iqr": "q75 - q25", "order_gap_q90_to_median": "q90 / (1 + usual)",
        "expected_orders_next_30d": "30 / (1 + usual)", "expected_orders_next_30d_with_overdue": "case when since > usual then 30 + since - usual else 30 end / (1 + usual)",
    }
    once = {"has_valid_order_gap": "(n > 1)::int", "has_single_order": "(n = 1)::int", "days_since_only_order": "case n when 1 then since else 0 end", "single_order_gmv": "case n when 1 then money else 0 end"}
    return _of_lists(panel, cutoff, once | {name: f"case when n > 1 then {x} else 0 end" for name, x in regular.items()})


def last_order_trend(panel: str, cutoff: str) -> str:
    before = "((coalesce(paid[2], 0) + coalesce(paid[3], 0)) / 2)"
    after = lambda what, e="true": f"(select coalesce(sum({what}), 0) from days where days.user_id = told.user_id and d < since and {e})"
    out = {
        "last_order_gmv_to_previous_two_mean": f"paid[1] / (1 + {before})", "last_order_gmv_trend_vs_previous_two": f"(paid[1] - {before}) / (1 + abs(paid[1]) + abs({before}))",
        "searches_after_last_order_per_day": f"{after('searches')} / (since + 1)", "cart_items_after_last_order_per_day": f"{after('items_added_to_cart')} / (since + 1)",
        "active_share_after_last_order": f"{after('active_days')} / (since + 1)", "has_search_after_last_order": f"({after('search_days')} > 0)::int", "has_cart_after_last_order": f"({after('cart_days')} > 0)::int",
    }
    return _of_lists(panel, cutoff, {name: f"case when n > 0 then {x} else 0 end" for name, x in out.items()})


def rfm_btyd_stats(panel: str, cutoff: str) -> str:
    return _of_lists(panel, cutoff, {
        "is_seen": "(len(activity) > 0)::int", "btyd_frequency": "case when n > 1 then n - 1 else 0 end", "btyd_recency": "case when n > 0 then age - since else 0 end", "btyd_T": "age",
        "order_frequency_per_age": "n / (age + 1)", "order_recency_to_age": "since / (age + 1)", "order_frequency_per_recency": "n / (since + 1)",
    })


def block_stats(panel: str, cutoff: str) -> str:
    rows = " union all ".join(f"select user_id, '{m}' as metric, d // 30 as k, {m}::double as v from days" for m in METRICS)
    own = {
        "block_mean": "avg(v)", "block_std": "stddev_pop(v)", "block_min": "min(v)", "block_max": "max(v)", "nonzero_blocks": "count_if(v > 0)", "zero_block_share": "avg((v <= 0)::int)",
        "positive_block_mean": "sum(v) / greatest(count_if(v > 0), 1)", "block_slope": "regr_slope(v, -k)", "block_ewm": "sum(v * power(0.75e0, k)) / sum(power(0.75e0, k))",
        "recent_to_block_mean": "(1 + max(v) filter (where k = 0)) / (1 + avg(v))", "recent_zero_block_run": "coalesce(min(k) filter (where v > 0), 9)",
    }
    texts = ", ".join(f"{x} as {name}" for name, x in own.items())
    return _days(panel, cutoff) + f""",
dealt as ({rows}),
per_block as (select user_id, metric, k, sum(v) as v from dealt group by all),
blocks as (
    select user_id, metric, t.k, coalesce(v, 0) as v
    from users cross join (values {", ".join(f"('{m}')" for m in METRICS)}) as ms(metric) cross join range(9) as t(k) left join per_block using (user_id, metric, k)
),
shaped as (select user_id, metric, {texts} from blocks group by user_id, metric)""" + _turned("shaped", "metric", {f"{m}_{name}": (name, m) for m in METRICS for name in own})


def families(panel: str, cutoff: str, windows: tuple[int, ...]) -> dict[str, str]:
    """SQL by family, for a recency of 270 days and nine blocks of 30."""
    return {
        "window_ratios": window_ratios(panel, cutoff, windows), "calendar_std": calendar_std(panel, cutoff, windows), "weekend_shares": weekend_shares(panel, cutoff), "nested_trends": nested_trends(panel, cutoff),
        "smoothed_trends": smoothed_trends(panel, cutoff), "channel_change": channel_change(panel, cutoff), "burstiness": burstiness(panel, cutoff), "purchase_cycle": purchase_cycle(panel, cutoff),
        "last_order_trend": last_order_trend(panel, cutoff), "phase_shares": phase_shares(panel, cutoff), "rfm_btyd_stats": rfm_btyd_stats(panel, cutoff), "intent_features": intent_features(panel, cutoff), "block_stats": block_stats(panel, cutoff),
    }
