"""Late events: in a stream's state, and in finished snapshots."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import snapshot as N
from tidemark.operators.incremental import SnapshotStore
from tidemark.plans.config import SnapshotConfig
from tidemark.sources.panel import events_panel
from tidemark.streaming import regularity as R

EVENTS = "user_id long, ts timestamp, event_type string, value double, props string"
CONFIG = SnapshotConfig("2024-01-20", windows=(7, 14, 20), recency=20, block_days=5, blocks=4, horizon=10, half_lives=(7,), weekend_windows=(14,), week_origin="2024-01-01", nested=((7, 14),), short=7, long=20)


def _events(seed=0, n=600, users=25, until=32):
    rng = np.random.default_rng(seed)
    kinds = ["view", "click", "purchase", "signup", "error"]
    return [(int(rng.integers(0, users)), datetime(2024, 1, 1) + timedelta(minutes=int(rng.integers(0, until * 1440))), kinds[rng.integers(0, 5)], round(float(rng.random() * 100), 2), "{}") for _ in range(n)]


def _streamed(spark, tmp_path, parts, schedule):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/part={k:03d}")
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"file://{tmp_path}/in/*")
    with R.state_store(spark):
        out = R.regularity_stream(source, schedule)
        out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    names = [n for n, _ in R.columns(schedule.recency)]
    return {(r.user_id, r.cutoff_date): [r[n] for n in names] for r in spark.read.schema(out.schema).parquet(f"file://{tmp_path}/out").collect()}


def _expected(rows, schedule, cutoffs):
    bits = {"view": 1, "signup": 1, "click": 5, "purchase": 3}
    out = {}
    for cutoff in cutoffs:
        at = (cutoff - R.EPOCH).days
        for user in {r[0] for r in rows}:
            days = {}
            for u, ts, kind, *_ in rows:
                day = (ts.date() - R.EPOCH).days
                if u == user and kind in bits and day <= at:
                    days[day] = days.get(day, 0) | bits[kind]
            if any(d > at - schedule.recency for d in days):
                out[user, cutoff] = R.features(days, at, schedule.recency)
    return out


def test_stream_state_gives_the_rows_of_all_events_in_any_order(spark, tmp_path):
    rows = sorted(_events(), key=lambda r: r[1] + timedelta(hours=hash(r) % 40))  # up to 40 hours out of order, within 2 days
    parts = [rows[i : i + 150] for i in range(0, len(rows), 150)]
    schedule = R.Schedule("2024-01-08", recency=9, step=7)
    cutoffs = [date(2024, 1, d) for d in (8, 15, 22, 29)]
    got = _streamed(spark, tmp_path, parts, schedule)
    want = _expected(rows, schedule, cutoffs)
    assert len(want) > 60 and want.keys() <= got.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row), key
    assert all(row[-3:] == [10, 10, 10] for key, row in got.items() if key not in want), "the last row of a user without days in the window"


def test_events_beyond_the_lateness_change_nothing(spark, tmp_path):
    day = lambda d, h=12: datetime(2024, 1, d, h)
    parts = [[(1, day(2), "purchase", 1.0, "{}"), (1, day(4), "purchase", 1.0, "{}")], [(2, day(12), "view", 0.0, "{}")], [(2, day(13), "view", 0.0, "{}")], [(1, day(3), "purchase", 1.0, "{}"), (None, day(13), "view", 0.0, "{}"), (1, None, "view", 0.0, "{}")], [(2, day(20), "error", 0.0, "{}"), (2, day(20), "view", 0.0, "{}")]]
    got = _streamed(spark, tmp_path, parts, R.Schedule("2024-01-08", recency=9, step=7, last="2024-01-15"))
    names = [n for n, _ in R.columns(9)]
    row = dict(zip(names, got[1, date(2024, 1, 8)], strict=True))
    assert row["order_gap_max_9d"] == 2 and row["order_longest_streak_9d"] == 1 and row["order_days_since_9d"] == 4
    assert (2, date(2024, 1, 15)) in got and max(d for _, d in got) == date(2024, 1, 15)


def _rows(df):
    return {r.user_id: [round(x, 6) if isinstance(x, float) else x for x in r] for r in df.collect()}


def test_late_events_give_the_snapshot_of_a_rebuild(spark, tmp_path):
    rows = spark.createDataFrame(_events(1) + [(99, datetime(2024, 1, 25), "purchase", 5.0, "{}")], EVENTS)
    after = F.to_date("ts") > "2024-01-20"
    target_only, fresh_user = (F.col("user_id") == 3) & after, F.col("user_id") == 24
    early = rows.where(~target_only & ~fresh_user & ~((F.col("user_id").isin(5, 6)) & (F.dayofmonth("ts") % 2 == 0)))
    store = SnapshotStore(spark, f"file://{tmp_path}/store", CONFIG, buckets=8)
    store.build(events_panel(early))
    before = _rows(store.current())
    one = store.apply(events_panel(rows.where(target_only)))
    assert (one.version, one.touched, one.added, one.computed, one.days_read) == (2, 1, 1, 0, 0)
    two = store.apply(events_panel(rows.where(~target_only).exceptAll(early)))
    assert (two.version, two.touched, two.added, two.computed) == (3, 3, 0, 3)
    own_days = events_panel(rows).where(F.col("user_id").isin(5, 6, 24)).count()
    assert two.days_read == own_days, "only days of touched users are read"
    rebuilt = _rows(N.snapshot(events_panel(rows), CONFIG))
    assert _rows(store.current()) == rebuilt and _rows(store.current(version=1)) == before
    assert _rows(N.snapshot(store.panel(), CONFIG)) == rebuilt
    assert store.apply(events_panel(rows.limit(0))).touched == 0 and store.versions() == [1, 2, 3]


def test_a_killed_run_leaves_the_version_before(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame(_events(2, 80, 4), EVENTS)
    store = SnapshotStore(spark, f"file://{tmp_path}/store", CONFIG, buckets=2)
    store.build(events_panel(rows))
    before = _rows(store.current())

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr("tidemark.operators.incremental.rename", killed)
    with pytest.raises(KeyboardInterrupt):
        store.apply(events_panel(rows.limit(5)))
    assert store.versions() == [1] and _rows(store.current()) == before
