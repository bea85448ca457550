"""The panel queries as DuckDB SQL, for checking: the same definitions over separately written scans, frames and joins."""

from __future__ import annotations

from tidemark.operators import sequence as S
from tidemark.plans import features as P
from tidemark.plans.config import SequenceConfig, SnapshotConfig

PERCENTILE = "quantile_cont({x}, {q})"
DISTINCT = "count(distinct {x})"

COLUMNS = "user_id, event_date, search, cat, has_search_to_cart, has_search_to_ord, has_cat_to_cart, has_cat_to_ord, search_to_cart, search_to_ord, cat_to_cart, cat_to_ord, to_cart, to_ord, searches, gmv_search, gmv_cat, gmv"

_HAS = "cast(search_to_cart > 0 as integer) has_search_to_cart, cast(search_to_ord > 0 as integer) has_search_to_ord, cast(cat_to_cart > 0 as integer) has_cat_to_cart, cast(cat_to_ord > 0 as integer) has_cat_to_ord"

ORDERS_PANEL = f"""
lines as (select l_orderkey, count(*) n, count(*) filter (where l_returnflag <> 'R') kept from lineitem group by 1),
placed as (
    select o_custkey user_id, cast(o_orderdate as date) event_date, o_orderpriority in ('1-URGENT', '2-HIGH') urgent, coalesce(n, 0) n, coalesce(kept, 0) kept, o_totalprice price
    from orders left join lines on o_orderkey = l_orderkey
),
summed as (
    select user_id, event_date, max(cast(urgent as integer)) search, max(cast(not urgent as integer)) cat, cast(count(*) filter (where urgent) as bigint) searches,
        cast(sum(n) as bigint) to_cart, cast(coalesce(sum(n) filter (where urgent), 0) as bigint) search_to_cart, cast(coalesce(sum(n) filter (where not urgent), 0) as bigint) cat_to_cart,
        cast(sum(kept) as bigint) to_ord, cast(coalesce(sum(kept) filter (where urgent), 0) as bigint) search_to_ord, cast(coalesce(sum(kept) filter (where not urgent), 0) as bigint) cat_to_ord,
        sum(price) gmv, coalesce(sum(price) filter (where urgent), 0) gmv_search, coalesce(sum(price) filter (where not urgent), 0) gmv_cat
    from placed group by 1, 2
),
panel as (select *, {_HAS} from summed)"""

EVENTS_PANEL = f"""
tagged as (
    select user_id, cast(ts as date) event_date, event_type kind, value, coalesce(cast(json_extract_string(props, '$.k') as bigint), 0) % 2 = 1 odd from events
),
summed as (
    select user_id, event_date, max(cast(kind = 'view' as integer)) search, max(cast(kind = 'signup' as integer)) cat, count(*) filter (where kind = 'view') searches,
        count(*) filter (where kind = 'click') to_cart, count(*) filter (where kind = 'click' and not odd) search_to_cart, count(*) filter (where kind = 'click' and odd) cat_to_cart,
        count(*) filter (where kind = 'purchase') to_ord, count(*) filter (where kind = 'purchase' and not odd) search_to_ord, count(*) filter (where kind = 'purchase' and odd) cat_to_ord,
        coalesce(sum(value) filter (where kind = 'purchase'), 0) gmv, coalesce(sum(value) filter (where kind = 'purchase' and not odd), 0) gmv_search, coalesce(sum(value) filter (where kind = 'purchase' and odd), 0) gmv_cat
    from tagged group by 1, 2
),
panel as (select *, {_HAS} from summed)"""


def _select(texts: P.Definitions) -> str:
    return ",\n    ".join(f"{text} as {name}" for name, text in texts)


def flags_sql(panel: str) -> str:
    return f"with {panel}\nselect {COLUMNS}, {', '.join(f'cast({t} as integer) {n}' for n, t in P.DAY_FLAGS)} from panel"


def history_ctes(panel: str, c: SnapshotConfig) -> str:
    flags = ", ".join(f"cast({t} as integer) as {n}" for n, t in P.DAY_FLAGS)
    return f"""with {panel},
h as (
    select *, {flags}, cast(date_diff('day', event_date, date '{c.cutoff}') as integer) d,
        cast(floor(date_diff('day', date '{c.week_origin}', event_date) / 7) as integer) as week, year(event_date) * 12 + month(event_date) as month, cast(isodow(event_date) >= 6 as integer) as weekend,
        case when day(event_date) <= 7 then '1_7' when day(event_date) <= 15 then '8_15' when day(event_date) <= 23 then '16_23' else '24_end' end as phase
    from panel where event_date >= date '{c.cutoff}' - interval {c.recency - 1} day and event_date <= date '{c.cutoff}' + interval {c.horizon} day
),
base as (select user_id, {_select([*P.window_sums(c), *P.window_squares(c), *P.window_maxima(c), *P.blocks(c), *P.target(c), *P.recency(c), *P.distinct_periods(c, DISTINCT), *P.weekends(c), *P.last_order_day(c), *P.order_day_money(c, PERCENTILE), *P.phases(c), *P.decays(c)])} from h group by user_id),
ranked as (
    select h.*, row_number() over (partition by h.user_id order by case when order_day = 1 then 0 else 1 end, event_date desc) order_rank, o.last_order
    from h left join (select user_id, min(d) last_order from h where order_day = 1 and d >= 0 group by user_id) o using (user_id) where d >= 0
),
recent as (select user_id, {_select(P.last_orders(c) + P.after_last_order(c))} from ranked group by user_id),
long as ({" union all ".join(f"select user_id, '{e}' event, event_date, d from h where {P.EVENTS[e]} = 1 and d >= 0" for e in P.REGULAR)}),
gapped as (select *, date_diff('day', lag(event_date) over (partition by user_id, event order by event_date), event_date) gap from long),
gaps as (select user_id, {_select(P.gaps(c, PERCENTILE))} from gapped group by user_id),
islands as (select user_id, event, d + row_number() over (partition by user_id, event order by event_date) island from long),
runs as (select user_id, event, island, count(*) length from islands group by all),
streaks as (select user_id, {_select(P.streaks(c))} from runs group by user_id),
spine as (select distinct user_id from panel),
joined as (select * from spine left join base using (user_id) left join recent using (user_id) left join gaps using (user_id) left join streaks using (user_id))"""


def base_names(c: SnapshotConfig) -> list[str]:
    texts = [*P.window_sums(c), *P.window_squares(c), *P.window_maxima(c), *P.blocks(c), *P.target(c), *P.recency(c), *P.distinct_periods(c, DISTINCT), *P.weekends(c), *P.last_order_day(c), *P.order_day_money(c, PERCENTILE), *P.phases(c), *P.decays(c), *P.last_orders(c), *P.after_last_order(c), *P.gaps(c, PERCENTILE), *P.streaks(c)]
    return [name for name, _ in texts]


def filled_ctes(panel: str, c: SnapshotConfig) -> str:
    absent = {f"days_since_last_{e}_{c.recency}d": c.recency + 1 for e in P.EVENTS} | {f"never_{e}_{c.recency}d": 1 for e in P.EVENTS}
    return history_ctes(panel, c) + ",\nfilled as (select user_id, " + ", ".join(f"coalesce({n}, {absent.get(n, 0)}) {n}" for n in base_names(c)) + " from joined)"


def _rounded(names: list[str]) -> str:
    return ", ".join(f"round(cast({n} as double), 6) + 0e0 as {n}" for n in names)


def base_sql(panel: str, c: SnapshotConfig, names: list[str]) -> str:
    return f"{filled_ctes(panel, c)}\nselect user_id, {_rounded(names)} from filled"


def snapshot_sql(panel: str, c: SnapshotConfig, names: list[str]) -> str:
    texts = [x for family in P.DERIVED.values() for x in family(c)]
    return f"{filled_ctes(panel, c)},\nfinal as (select *, {_select(texts)} from filled)\nselect user_id, date '{c.cutoff}' cutoff_date, {_rounded(['target', *names])} from final"


def sequence_ctes(panel: str, c: SequenceConfig) -> str:
    values = ", ".join(f"coalesce({v}, 0) {v}" for v in S.VALUES)
    zeros = ", ".join(f"0 {v}" for v in S.VALUES)
    names = ", ".join(S.VALUES)
    return f"""with {panel},
ahead as (select user_id, sum(gmv) target from panel where event_date > date '{c.cutoff}' and event_date <= date '{c.cutoff}' + interval {c.horizon} day group by 1),
users as (select u.user_id, coalesce(target, 0) target from (select distinct user_id from panel) u left join ahead using (user_id)),
past as (select *, cast(date_diff('day', date '{c.cutoff}' - interval {c.history - 1} day, event_date) as integer) day_index from panel where event_date > date '{c.cutoff}' - interval {c.history} day and event_date <= date '{c.cutoff}'),
days as (select user_id, event_date, coalesce(day_index, -1) day_index, {values}, target from users left join past using (user_id)),
stated as (
    select user_id, event_date, day_index, {names}, target, 0 cutoff_state_row from days
    union all
    select user_id, date '{c.cutoff}', {c.history - 1}, {zeros}, target, 1 from users where user_id not in (select user_id from past where day_index = {c.history - 1})
)"""


def sequence_days_sql(panel: str, c: SequenceConfig) -> str:
    names = ", ".join(S.VALUES)
    return f"{sequence_ctes(panel, c)}\nselect user_id, event_date, day_index, {_rounded([*S.VALUES, 'target'])} from days"


def state_rows_sql(panel: str, c: SequenceConfig) -> str:
    return f"{sequence_ctes(panel, c)}\nselect user_id, event_date, day_index, cutoff_state_row, {_rounded([*S.VALUES, 'target'])} from stated"


def sequence_sql(panel: str, c: SequenceConfig, families: tuple[str, ...]) -> str:
    texts = [x for f in families for x in S.family_texts(f, c, "(isodow(event_date) - 1)", "dayofyear(event_date)")]
    zeros = ", ".join(f"0 {n}" for n, _ in texts)
    return f"""{sequence_ctes(panel, c)},
final as (
    select user_id, day_index, {_select(texts)} from stated where day_index >= 0
    union all select user_id, day_index, {zeros} from stated where day_index < 0
)
select user_id, day_index, {_rounded([n for n, _ in texts])} from final"""
