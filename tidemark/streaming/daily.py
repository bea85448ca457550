"""The daily panel and decayed sums over a stream of events: an extension for late and unbounded data.

Days close when the watermark passes their end; a closed day's row is that of the batch panel. Decayed sums are kept as
state by user: each closed day multiplies them by the decay of the days gone by and adds its values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECAY_OUT = "user_id long, event_date date, decay_gmv double, decay_searches double"
DECAY_STATE = "day long, gmv double, searches double"


def daily_stream(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """user_id, event_date and counts by kind of each closed day; events later than the watermark are dropped."""
    kind = F.col("event_type")
    sums = {"searches": kind == "view", "to_cart": kind == "click", "to_ord": kind == "purchase"}
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    by = timed.groupBy(F.window("ts", "1 day"), "user_id").agg(*[F.sum(on.cast("long")).alias(n) for n, on in sums.items()], F.sum(F.when(kind == "purchase", F.coalesce("value", F.lit(0.0))).otherwise(0.0)).alias("gmv"))
    return by.select("user_id", F.to_date("window.start").alias("event_date"), *sums, "gmv")


def decayed_stream(days: DataFrame, half_life: float = 30.0) -> DataFrame:
    """user_id, event_date and decayed sums after each day of a stream of daily rows, in the order of days."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("event_date")
        day, gmv, searches = state.get if state.exists else (None, 0.0, 0.0)
        out = []
        for r in rows.itertuples(index=False):
            now = pd.Timestamp(r.event_date).toordinal()
            # a day before the state's, let in by the watermark, is decayed to the state's day
            keep = 1.0 if day is None else 0.5 ** (max(0, now - day) / half_life)
            own = 1.0 if day is None or now >= day else 0.5 ** ((day - now) / half_life)
            gmv, searches = gmv * keep + own * r.gmv, searches * keep + own * r.searches
            day = now if day is None else max(day, now)
            out.append((key[0], r.event_date, gmv, searches))
        state.update((day, gmv, searches))
        yield pd.DataFrame(out, columns=["user_id", "event_date", "decay_gmv", "decay_searches"])

    return days.groupBy("user_id").applyInPandasWithState(step, DECAY_OUT, DECAY_STATE, "append", GroupStateTimeout.NoTimeout)
