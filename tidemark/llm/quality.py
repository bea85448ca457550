"""Quality by a factorization machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh
from tidemark.llm import factorization as fm
from tidemark.llm.text_vectors import LOWER, MARKS, SPACE, Chunk, Hashes, chunks, words

THRESHOLD = 0.3
#: Steps of each statistic; a step is a bucket.
STEPS = 12


def _rates(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Structure statistics of each row, as numbers from 0 to about 1."""
    n = chunk.rows
    row = np.repeat(np.arange(n), np.diff(chunk.bounds))
    size = np.maximum(np.diff(chunk.bounds), 1)
    share = lambda mask: np.bincount(row[mask], minlength=n) / size
    data = chunk.data
    among = lambda chars: np.isin(data, np.frombuffer(chars, np.uint8))
    count = np.bincount(rows, minlength=n)
    some = np.maximum(count, 1)
    keys = np.unique(np.stack([rows.astype(np.uint64), hashes]), axis=1) if len(rows) else np.zeros((2, 0), np.uint64)
    distinct = np.bincount(keys[0].astype(np.int64), minlength=n)
    same = np.flatnonzero((rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])) + 1 if len(rows) > 1 else np.zeros(0, np.int64)
    lines = np.bincount(row[data == 10], minlength=n) + 1
    upper = (data >= 65) & (data <= 90)
    return np.stack(
        [
            np.log1p(size) / 14,
            np.log1p(count) / 12,
            np.bincount(rows, weights=ends - starts, minlength=n) / some / 16,
            distinct / some,
            np.bincount(rows[same], minlength=n) / some,
            np.log1p(lines) / 8,
            np.log1p(size / lines) / 10,
            share(upper) * 2,
            share(among(b"|")) * 8,
            share(among(b"!?")) * 8,
            share(among(b"#*$%&<>")) * 4,
            share(among(b".,;:")) * 8,
            share((data >= 48) & (data <= 57)) * 4,
            share(SPACE[data]) * 4,
        ],
        1,
    )


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each row: distinct words, steps of the structure statistics, and the recorded length (n_chars)."""
    ids, sizes = [], []
    told = batch.column("n_chars").cast(pa.float64()) if "n_chars" in batch.schema.names else pa.nulls(len(batch), pa.float64())
    lengths = told.fill_null(-1).to_numpy(zero_copy_only=False)
    spread = np.uint64(fm.BUCKETS - 1)
    for chunk in chunks(batch.column("text")):
        starts, ends, rows = words(chunk, MARKS)
        hashes = Hashes(LOWER[chunk.data]).of(starts, ends)
        rates = _rates(chunk, starts, ends, rows, hashes)
        own = lengths[chunk.first : chunk.first + chunk.rows]
        rates = np.column_stack([rates, np.where(own < 0, -1, np.log1p(np.maximum(own, 0)) / 14)])
        step = np.clip(np.floor(rates * STEPS), -1, STEPS).astype(np.int64)
        stat = (np.arange(rates.shape[1]) * (STEPS + 2) + step + 1) * 2654435761 % int(spread)
        keys = np.concatenate([np.arange(chunk.rows) * fm.BUCKETS, rows * fm.BUCKETS + 1 + (hashes % spread).astype(np.int64), (np.arange(chunk.rows)[:, None] * fm.BUCKETS + 1 + stat).ravel()])
        keys = np.unique(keys)
        ids.append(keys % fm.BUCKETS)
        sizes.append(np.bincount(keys // fm.BUCKETS, minlength=chunk.rows))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.cumsum(size) - size


def _told(docs: DataFrame) -> list:
    return [F.col("n_chars").cast("double")] if "n_chars" in docs.columns else []


def _fitted(docs: DataFrame, labels: DataFrame, most_rows: int) -> fm.Model:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *_told(docs))
    return fm.train(rows, labels.select(F.col("doc_id").cast("long"), F.col("quality").alias("label")), features, most_rows)


def accepted(docs: DataFrame, labels: DataFrame, most_rows: int = fm.MOST_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that quality() predicts 1 for."""
    name = fresh(docs.columns, "_score")
    return fm.scored(docs, _fitted(docs, labels, most_rows), features, name).where(F.col(name) >= threshold).drop(name)


def quality(docs: DataFrame, labels: DataFrame, most_rows: int = fm.MOST_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of (doc_id, text, n_chars), learned from labels (doc_id, quality).

    Null and empty texts are scored by their statistics alone; a null n_chars (or none at all) is a step of its own.
    Repeated rows are scored each.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *_told(docs))
    model = _fitted(docs, labels, most_rows)
    return fm.predictions(docs, model, features, threshold)
