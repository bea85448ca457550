"""What a snapshot is made of: its windows, blocks and horizons."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SnapshotConfig:
    """Day 0 is the cutoff; a window of N days holds days 0 to N-1 before it, and the target days 1 to horizon after it."""

    cutoff: str
    windows: tuple[int, ...] = (7, 14, 30, 60, 90, 180, 270)
    recency: int = 270
    block_days: int = 30
    blocks: int = 9
    horizon: int = 30
    half_lives: tuple[int, ...] = (7, 14, 30, 60, 90)
    weekend_windows: tuple[int, ...] = (90, 180, 270)
    week_origin: str = "2025-01-01"
    #: Recent windows and the wider ones that hold them, in days.
    nested: tuple[tuple[int, int], ...] = ((7, 14), (30, 60), (90, 180))
    short: int = 30
    long: int = 180

    def __post_init__(self) -> None:
        if max(self.windows) > self.recency or self.block_days * self.blocks > self.recency:
            raise ValueError("windows and blocks must lie within the recency window")


@dataclass(frozen=True)
class SequenceConfig:
    """Daily rows of the last ``history`` days; day_index runs from 0 to history - 1, the cutoff."""

    cutoff: str
    history: int = 180
    horizon: int = 30
    lags: tuple[int, ...] = (1, 7, 14, 30)
    rolling: tuple[int, ...] = (7, 14, 30, 60, 90)
    detail: tuple[int, ...] = (7, 30, 90)
    half_lives: tuple[int, ...] = (7, 30)
    main: tuple[str, ...] = field(default=("gmv", "searches", "to_cart", "to_ord"))


#: The snapshots that the queries take of the driver's tables.
ORDERS = SnapshotConfig("2000-12-31", week_origin="1995-01-01")
EVENTS = SnapshotConfig("2024-01-20", windows=(7, 14, 20), recency=20, block_days=5, blocks=4, horizon=10, half_lives=(7, 14), weekend_windows=(14, 20), week_origin="2024-01-01", nested=((7, 14),), short=7, long=20)
ORDERS_SEQUENCE = SequenceConfig("2000-12-31")
EVENTS_SEQUENCE = SequenceConfig("2024-01-20", history=20, horizon=10)
