"""Gaps, streaks and recency of each user from an unbounded stream, at a schedule of cutoffs.

A user's state is a map from day to the kinds of events on it: it doesn't matter in which order events come. Days older than
the recency window before the next cutoff are dropped, and a user without days is forgotten, so a state holds at most the
days of the window and of the lateness. An event-time timer closes a cutoff once the watermark has passed the end of its
day, writes the user's row and sets the timer of the next. Events
later than the watermark of the batch before allows are dropped by Spark; those let in count at cutoffs that are still open.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.plans.features import REGULAR

#: Bits of a day's kinds.
BITS = {"activity": 1, "order": 2, "cart": 4}
DAY_MS = 86_400_000
EPOCH = date(1970, 1, 1)
GAPS, SHARES = ("mean", "median", "std", "max", "last"), (25, 75, 90)


@dataclass(frozen=True)
class Schedule:
    """Cutoffs every step days from the first to the last on (to no end if there is none), each over its last recency days."""

    first: str
    recency: int
    step: int = 7
    last: str | None = None

    def after(self, day: int) -> int | None:
        """The first cutoff on that day (since 1970) or later."""
        first = (date.fromisoformat(self.first) - EPOCH).days
        at = first + max(0, -(-(day - first) // self.step)) * self.step
        return None if self.last is not None and at > (date.fromisoformat(self.last) - EPOCH).days else at


def columns(recency: int) -> list[tuple[str, str]]:
    """Names and types of the features of a row."""
    regular = [(f"{e}_gap_{g}_{recency}d", "bigint" if g in ("max", "last") else "double") for e in REGULAR for g in GAPS]
    shares = [(f"order_gap_q{q}_{recency}d", "double") for q in SHARES]
    return regular + shares + [(f"{e}_longest_streak_{recency}d", "bigint") for e in REGULAR] + [(f"{e}_days_since_{recency}d", "bigint") for e in REGULAR]


def features(days: dict[int, int], cutoff: int, recency: int) -> list:
    """The features of a user's days (with their kinds) at a cutoff; days outside of the window are passed over."""
    gaps, streaks, since, order = [], [], [], np.zeros(0)
    for e in REGULAR:
        own = np.array(sorted(d for d, kinds in days.items() if kinds & BITS[e] and cutoff - recency < d <= cutoff), np.int64)
        between = np.diff(own)
        if e == "order":
            order = between
        n = len(between)
        gaps += [float(between.mean()), float(np.median(between)), float(between.std(ddof=1)) if n > 1 else 0.0, int(between.max()), int(between[-1])] if n else [0.0, 0.0, 0.0, 0, 0]
        breaks = np.flatnonzero(between > 1)
        streaks.append(int(np.diff(np.concatenate([[-1], breaks, [len(own) - 1]])).max()) if len(own) else 0)
        since.append(cutoff - int(own[-1]) if len(own) else recency + 1)
    return [*gaps, *(float(np.quantile(order, q / 100)) if len(order) else 0.0 for q in SHARES), *streaks, *since]


class Regularity(StatefulProcessor):
    def __init__(self, schedule: Schedule):
        self.schedule = schedule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "kinds int")

    def _close_next(self, day: int) -> None:
        """Sets the timer of the first cutoff on that day or later; setting it again changes nothing."""
        cutoff = self.schedule.after(day)
        if cutoff is not None:
            self.handle.registerTimer((cutoff + 1) * DAY_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, int] = {}
        for batch in rows:
            for day, kinds in zip(batch["day"].tolist(), batch["kinds"].tolist(), strict=True):
                found[day] = found.get(day, 0) | kinds
        for day, kinds in found.items():
            before = self.days.getValue((day,))[0] if self.days.containsKey((day,)) else 0
            if before | kinds != before:
                self.days.updateValue((day,), (before | kinds,))
        # a cutoff is open until the watermark has passed the end of its day
        self._close_next(max(0, timerValues.getCurrentWatermarkInMs()) // DAY_MS)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cutoff = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        days = {d[0]: k[0] for d, k in self.days.iterator()}
        recency, following = self.schedule.recency, self.schedule.after(cutoff + 1)
        if any(d <= cutoff for d in days):
            row = [key[0], EPOCH + timedelta(days=cutoff), *features(days, cutoff, recency)]
            yield pd.DataFrame([row], columns=["user_id", "cutoff_date", *(n for n, _ in columns(recency))])
        left = [d for d in days if following is not None and d > following - recency]
        for d in days.keys() - set(left):
            self.days.removeKey((d,))
        if left:
            self._close_next(cutoff + 1)
        else:
            self.days.clear()

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """The session with the state store that timers and maps need, as long as queries are started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield spark
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def regularity_stream(events: DataFrame, schedule: Schedule, lateness: str = "2 days") -> DataFrame:
    """user_id, cutoff_date and features of each user that has events up to a cutoff in the state, once the cutoff is closed.

    events: user_id, ts, event_type of a stream; other columns are passed over, and so are rows without a user or time, and
    kinds of events that aren't activity. Start the query within state_store(). A user all of whose days are out of the window has
    one row more (zeros, and recencies one more than the window), then none until it is seen again.
    """
    kind = F.col("event_type")
    kinds = F.when(kind == "purchase", BITS["activity"] | BITS["order"]).when(kind == "click", BITS["activity"] | BITS["cart"]).when(kind.isin("view", "signup"), BITS["activity"])
    rows = events.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), kinds.cast("int").alias("kinds")).where("user_id is not null and ts is not null and kinds is not null")
    rows = rows.withColumn("day", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))).withWatermark("ts", lateness)
    out = ", ".join(["user_id bigint", "cutoff_date date", *(f"{n} {t}" for n, t in columns(schedule.recency))])
    return rows.groupBy("user_id").transformWithStateInPandas(Regularity(schedule), out, "Append", "EventTime")
