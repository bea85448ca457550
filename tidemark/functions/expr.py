"""Scalar functions of the feature definitions, as SQL text and as Columns.

Definitions are kept as SQL text that any engine with standard functions reads, so one text serves Spark (through
``F.expr``) and the checking engine. Division by zero gives 0, also under ANSI rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: str, b: str) -> str:
    """a / b; 0 where b is 0 or the result is null."""
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


def change(recent: str, previous: str) -> str:
    """The difference over the sum of sizes plus one: between -1 and 1."""
    return f"(({recent}) - ({previous})) / (abs({recent}) + abs({previous}) + 1)"


def above_zero(x: str) -> str:
    return f"greatest({x}, 0)"


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column, edge: float = 1e-6) -> Column:
    """Log-odds of p, kept ``edge`` away from 0 and 1."""
    inside = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return F.ln(inside / (1 - inside))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def bounded_change(recent: Column, previous: Column) -> Column:
    return (recent - previous) / (F.abs(recent) + F.abs(previous) + 1)


def clipped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x between low and high; null stays null."""
    out = x
    if low is not None:
        out = F.when(x.isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(x.isNotNull(), F.least(out, F.lit(high)))
    return out


def finite(x: Column) -> Column:
    """x, or 0 where it is null, not a number or infinite."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
