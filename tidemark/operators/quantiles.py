"""Exact quantiles of very many distinct values, by distributed selection.

The values at the ranks asked for are found by histograms: a pass counts the values of each open range by bin, and the bin that
holds a rank is its next range, from the least to the largest value in it. A range of one value ends the search. A task holds
BINS counts a range, whatever the number of values, and so does the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import drop, settle

BINS = 1024


def _selected(values: DataFrame, asked: dict[str, set[int]], ends: dict[str, tuple[float, float]], bins: int) -> dict[tuple[str, int], float]:
    """The value at each rank (from 0) of each name in values (name, v)."""
    found: dict[tuple[str, int], float] = {}
    ranges = [(name, *ends[name], 0, ranks) for name, ranks in asked.items()]  # name, least, largest, values before it, ranks
    while ranges:
        open_ranges = []
        for name, lo, hi, before, ranks in ranges:
            if lo == hi:
                found |= {(name, k): lo for k in ranks}
            else:
                open_ranges.append((name, lo, hi, before, ranks))
        if not open_ranges:
            break
        cases = []
        for i, (name, lo, hi, _, _) in enumerate(open_ranges):
            scale = 0.5 if math.isinf(hi - lo) else 1.0
            at = F.floor((F.col("v") * scale - lo * scale) / (hi * scale - lo * scale) * bins)
            here = (F.col("name") == name) & F.col("v").between(lo, hi)
            cases.append(F.when(here, F.struct(F.lit(i).alias("range"), F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))))
        counted = values.select("v", F.coalesce(*cases).alias("x")).where("x is not null").groupBy("x.range", "x.bin")
        rows = sorted(counted.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: (r.range, r.bin))  # ranges times bins rows
        ranges = []
        for i, (name, _, _, before, ranks) in enumerate(open_ranges):
            for r in (r for r in rows if r.range == i):
                inside = {k for k in ranks if before <= k < before + r.n}
                if inside:
                    ranges.append((name, r.lo, r.hi, before, inside))
                before += r.n
    return found


def exact_quantiles(long: DataFrame, shares: dict[str, list[float]], name: str = "name", value: str = "value", bins: int = BINS) -> dict[str, list[float | None]]:
    """By name, its values' quantiles at its shares, interpolated between ranks as the percentile function does.

    long has a row for each name and value; names that shares doesn't have are passed over. Nulls and undefined values
    aren't counted, infinite ones are the largest doubles. A name without values has nulls.
    """
    largest = F.lit(1.7976931348623157e308)
    v = F.greatest(F.least(F.col(value).cast("double"), largest), -largest)
    values = settle(long.where(F.col(name).isin(list(shares)) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(name).alias("name"), v.alias("v")), "values")
    sizes = {r.name: r for r in values.groupBy("name").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    places = {(m, q): q * (sizes[m].n - 1) for m, qs in shares.items() if m in sizes for q in qs}
    asked: dict[str, set[int]] = {}
    for (m, _), at in places.items():
        asked.setdefault(m, set()).update((math.floor(at), math.ceil(at)))
    found = _selected(values, asked, {m: (sizes[m].lo, sizes[m].hi) for m in asked}, bins)
    drop(values)

    def between(m: str, q: float) -> float | None:
        if m not in sizes:
            return None
        at = places[m, q]
        low, high = found[m, math.floor(at)], found[m, math.ceil(at)]
        share = at - math.floor(at)
        return low if low == high else (1 - share) * low + share * high

    return {m: [between(m, q) for q in qs] for m, qs in shares.items()}
