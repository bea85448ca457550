"""Checks of tables, each by one aggregation; they raise ValueError and say what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str], name: str) -> None:
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"{name}: keys {keys} repeat")


def require_columns(df: DataFrame, names: list[str]) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"columns are missing: {missing}")


def require_rows(df: DataFrame, name: str) -> None:
    if df.isEmpty():
        raise ValueError(f"{name} is empty")


def require_agreement(df: DataFrame, a: str, b: str, tolerance: float) -> None:
    worst = df.agg(F.max(F.abs(F.col(a) - F.col(b)))).first()[0]
    if worst is not None and worst > tolerance:
        raise ValueError(f"{a} and {b} differ by {worst}")


def prediction_report(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """rows, users, nulls, undefined and negatives of a prediction table in one row; one aggregation."""
    keys = keys or ["user_id"]
    x = F.col(column).cast("double")
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(*[F.col(k) for k in keys]).alias("n_keys"), F.count_if(x.isNull()).alias("n_null"), F.count_if(F.isnan(x)).alias("n_nan"), F.count_if(x < 0).alias("n_negative"))


def require_predictions(df: DataFrame, column: str, rows: int | None = None) -> None:
    r = prediction_report(df, column).first()
    if r["n_rows"] != r["n_keys"] or r["n_null"] or r["n_nan"] or r["n_negative"] or (rows is not None and r["n_rows"] != rows):
        raise ValueError(f"bad predictions: {r.asDict()}")
