"""The snapshot on hand-made panels: values worked out by hand, and invariants."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from tidemark.operators import snapshot as N
from tidemark.plans import by_hand
from tidemark.plans import features as P
from tidemark.plans.config import ORDERS, SnapshotConfig
from tidemark.sources.panel import PANEL

CUTOFF = dt.date(2025, 8, 17)
C = SnapshotConfig(CUTOFF.isoformat())


def row(user, days_before, **values):
    base = {f.name: 0.0 if f.name.startswith("gmv") else 0 for f in PANEL} | {"user_id": user, "event_date": CUTOFF - dt.timedelta(days=days_before)} | values
    return tuple(base[f.name] for f in PANEL)


def snap(spark, rows, c=C):
    return {r.user_id: r.asDict() for r in N.snapshot(spark.createDataFrame(rows, PANEL), c).collect()}


@pytest.fixture(scope="module")
def cases(spark):
    rows = [row(1, -1, gmv=5.0, to_ord=1)]
    rows += [row(2, 0, gmv=5.0), row(2, -1, gmv=7.0), row(2, -30, gmv=9.0), row(2, -31, gmv=11.0)]
    rows += [row(3, 29, gmv=1.0), row(3, 30, gmv=2.0)]
    rows += [row(4, 10, to_ord=3, gmv=12.0)]
    rows += [row(5, 9, to_ord=1, gmv=1.0), row(5, 6, to_ord=1, gmv=4.0), row(5, 1, to_ord=1, gmv=7.0), row(5, 0, searches=4, search=1)]
    rows += [row(6, d, search=1) for d in (5, 4, 3, 1)]
    rows += [row(8, 3)]
    rows += [row(9, 65, gmv=3.0)]
    rows += [row(10, 7, gmv=8.0)]
    return snap(spark, rows)


def test_feature_count():
    names = N.feature_names(ORDERS)
    assert len(names) == len(set(names)) == 681


def test_no_history(cases):
    r = cases[1]
    assert r["target"] == 5 and r["gmv_270d"] == 0
    assert r["days_since_last_order_270d"] == 271 and r["never_order_270d"] == 1 and r["is_seen_270d"] == 0


def test_boundaries(cases):
    assert cases[2]["gmv_7d"] == 5 and cases[2]["target"] == 16
    assert cases[3]["gmv_block_0_30d"] == 1 and cases[3]["gmv_block_1_30d"] == 2


def test_orders(cases):
    r = cases[4]
    assert r["has_single_order_270d"] == 1 and r["days_since_only_order_270d"] == 10 and r["single_order_gmv_270d"] == 12 and r["order_gap_mean_270d"] == 0
    r = cases[5]
    assert r["order_gap_mean_270d"] == r["order_gap_median_270d"] == 4
    assert r["order_gap_std_270d"] == pytest.approx(2**0.5)
    assert r["order_gap_max_270d"] == r["order_gap_last_270d"] == 5 and r["order_gap_q25_270d"] == 3.5
    assert [r[f"last_{k}_order_day_gmv_270d"] for k in (1, 2, 3)] == [7, 4, 1]
    assert r["searches_after_last_order_270d"] == 4 and r["last_order_gmv_to_previous_two_mean_270d"] == 7 / 3.5


def test_streaks_zero_days_and_decay(cases):
    assert cases[6]["activity_longest_streak_270d"] == 3
    assert cases[8]["recorded_days_270d"] == 1 and cases[8]["active_days_270d"] == 0 and cases[8]["recorded_zero_days_270d"] == 1
    assert cases[9]["gmv_recent_zero_block_run"] == 2
    assert cases[10]["decay_gmv_halflife_7d"] == 4


def test_phases(spark):
    days = {7: "1_7", 8: "8_15", 15: "8_15", 16: "16_23", 23: "16_23", 24: "24_end"}
    rows = [row(1, (CUTOFF - dt.date(2025, 7, d)).days, to_ord=1) for d in days]
    r = snap(spark, rows)[1]
    assert [r[f"order_days_month_phase_{p}_270d"] for p in ("1_7", "8_15", "16_23", "24_end")] == [1, 2, 2, 1]


def random_panel(spark, seed=1):
    import random

    rng = random.Random(seed)
    seen = {(rng.randint(1, 12), rng.randint(-40, 300)) for _ in range(500)}
    return [row(u, d, gmv=float(rng.randint(0, 50)), to_ord=rng.randint(0, 2), to_cart=rng.randint(0, 3), searches=rng.randint(0, 4), search=rng.randint(0, 1), cat=rng.randint(0, 1)) for u, d in sorted(seen)]


def test_invariants_leakage_and_order(spark):
    rows = random_panel(spark)
    own = snap(spark, rows)
    for r in own.values():
        assert sum(r[f"gmv_block_{k}_30d"] for k in range(9)) == pytest.approx(r["gmv_270d"])
        sums = [r[f"gmv_{n}d"] for n in C.windows]
        assert sums == sorted(sums)
        assert all(-1 <= v <= 1 for n, v in r.items() if "_vs_previous_" in n and "two" not in n)
    after = [(*x[:-1], x[-1] + 100) if x[1] > CUTOFF else x for x in rows]
    changed = snap(spark, list(reversed(after)))
    for u, r in own.items():
        assert {k: v for k, v in r.items() if k != "target"} == pytest.approx({k: v for k, v in changed[u].items() if k != "target"})


def test_derived_families_equal_sql_written_apart(spark):
    """All derived features of a random panel, against SQL that shares no formula with them."""
    con = duckdb.connect()
    rows = pd.DataFrame([*random_panel(spark, 2), row(99, 400, to_ord=1, gmv=3.0), row(98, 3, to_ord=2, to_cart=1, gmv=5.0)], columns=[f.name for f in PANEL])
    con.register("daily", rows)
    own = snap(spark, [tuple(r) for r in rows.itertuples(index=False)])
    seen = set()
    for family, sql in by_hand.families("panel as (select * replace (cast(event_date as date) as event_date) from daily)", C.cutoff, C.windows).items():
        for r in con.execute(sql).df().to_dict("records"):
            user = r.pop("user_id")
            assert {n: own[user][n] for n in r} == pytest.approx(r, abs=2e-6), family
            seen |= r.keys()
    assert seen == {n for family in P.DERIVED.values() for n, _ in family(C)}


def test_narrowed_and_cutoffs(spark):
    df = N.narrowed(spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "user_id long, x double"))
    assert [r.x for r in df.orderBy("user_id").collect()] == [0, 0, 1.5] and dict(df.dtypes)["x"] == "float"
    assert N.cutoffs("2025-08-17", "2025-08-31", last="2025-09-02") == ["2025-08-17", "2025-08-24", "2025-08-31", "2025-09-02"]
