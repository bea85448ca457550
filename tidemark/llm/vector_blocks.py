"""Whole-number vectors in blocks: what the operators over vectors that learn in rounds share.

A block is a row with the vectors that one task read, at most BLOCK numbers of them (and one vector at least), packed into
binary columns. Blocks are made without a shuffle, so a key that holds many rows is of no account.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Numbers in a block.
BLOCK = 1 << 18
#: Components beyond this count as this, so that squared distances of a few hundred components fit in 64 bits.
WIDEST = 1 << 26
#: Below this, sums of squares of a few hundred components are exact as doubles.
NARROW = 1 << 21


def whole(vectors: DataFrame, *carried: str, scale: int = SCALE) -> DataFrame:
    """vec_id, parts (floor(scale * x) of each component, as integers) and the carried columns, of the sound vectors.

    A vector that is null or holds null or non-finite components isn't sound.
    """
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    part = lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit(WIDEST)), F.lit(-WIDEST)).cast("int")
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, part).alias("parts"), *carried)


def packed_longs(values: pd.Series) -> tuple[bytes, bytes]:
    """Whole numbers and nulls as bytes: the numbers (0 for a null), and 1 for each that isn't null."""
    there = values.notna().to_numpy()
    return np.array([int(v) if ok else 0 for v, ok in zip(values, there, strict=True)], "<i8").tobytes(), there.astype("u1").tobytes()


def longs(packed: bytes, there: bytes) -> pd.Series:
    return pd.Series(np.frombuffer(packed, "<i8"), dtype="Int64").where(np.frombuffer(there, "u1").astype(bool))


def in_blocks(rows: DataFrame, dim: int, make: Callable[[pd.DataFrame, np.ndarray], tuple], schema: str, most: int = BLOCK) -> DataFrame:
    """make(rows, their vectors) for each block of rows whose parts have dim components."""
    size = max(1, most // max(1, dim))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def block() -> pd.DataFrame:
            all_rows = pd.concat(held, ignore_index=True)
            held.clear()
            if len(all_rows) > size:
                held.append(all_rows.iloc[size:])
                all_rows = all_rows.iloc[:size]
            return pd.DataFrame([make(all_rows, np.stack(all_rows["parts"].to_numpy()).astype(np.int64))], columns=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            if len(batch):
                held.append(batch)
            while sum(map(len, held)) >= size:
                yield block()
        if held:
            yield block()

    return rows.where(F.size("parts") == dim).mapInPandas(run, schema)


def exact_kind(*arrays: np.ndarray) -> type:
    """The number type in which squared distances between these whole numbers are exact: doubles are several times as fast."""
    return np.float64 if max((int(np.abs(a).max(initial=0)) for a in arrays), default=0) <= NARROW else np.int64


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, exact in the type they have."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]
