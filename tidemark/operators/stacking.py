"""Stacking tables: out-of-fold and test predictions of several models side by side, with their guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.operators.guards import require_agreement, require_unique

KEYS = ["user_id", "snapshot_name"]
PREDICTIONS = ("predict", "target", "pred", "prediction")
MONEY_WORDS = ("gmv", "revenue", "amount", "price", "value")


def merge_oof(base: DataFrame, other: DataFrame, name: str, column: str, tolerance: float = 1e-5, check: bool = True) -> DataFrame:
    """base with the other model's column as ``name``, joined on user and snapshot; null where it has no row.

    With check, keys must be unique in the other table and targets agree.
    """
    if check:
        require_unique(other, KEYS, name)
        require_agreement(base.join(other.select(*KEYS, F.col("target").alias("_t")), KEYS), "target", "_t", tolerance)
    return base.join(other.select(*KEYS, F.col(column).alias(name)), KEYS, "left")


def stack(head: DataFrame, models: dict[str, tuple[DataFrame, str]], check: bool = True) -> DataFrame:
    """The head with all models' columns in sorted order, complete cases only."""
    out = reduce(lambda a, m: merge_oof(a, models[m][0], m, models[m][1], check=check), sorted(models), head)
    return out.na.drop(subset=sorted(models)).select(*head.columns, *sorted(models))


def prediction_column(df: DataFrame) -> str:
    """The column that holds predictions, by its usual names."""
    found = [c for c in PREDICTIONS if c in df.columns]
    if not found:
        raise ValueError(f"no prediction among {df.columns}")
    return found[0]


def pick_features(df: DataFrame, wanted: list[str], keywords: list[str], most: int = 45, excluded: tuple[str, ...] = ("user_id", "cutoff_date", "target")) -> list[str]:
    """Wanted names that exist, then names that hold a keyword, then the first numeric ones, up to ``most``. Schema only."""
    names = [c for c in df.columns if c not in excluded]
    ordered = [c for c in wanted if c in names]
    ordered += [c for k in keywords for c in names if k in c.lower()]
    ordered += [f.name for f in df.schema if f.name in names and isinstance(f.dataType, NumericType)]
    return list(dict.fromkeys(ordered))[:most]


def with_base_features(stacked: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """stacked with base_<name> of each feature, finite, and base_<name>_log1p where the name speaks of money."""
    ok = lambda n: F.when(F.col(n).isNull() | F.isnan(F.col(n).cast("double")) | (F.abs(F.col(n).cast("double")) == float("inf")), F.lit(0.0)).otherwise(F.col(n).cast("double"))
    own = [ok(n).alias(f"base_{n}") for n in names]
    own += [F.log1p(F.greatest(F.lit(0.0), ok(n))).alias(f"base_{n}_log1p") for n in names if any(w in n.lower() for w in MONEY_WORDS)]
    return stacked.join(features.select("user_id", *own), "user_id", "left")
