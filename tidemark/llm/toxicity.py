"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import factorization as fm
from tidemark.llm.text_vectors import LOWER, MARKS, Hashes, chunks, words

THRESHOLD = 0.5
#: Bytes of a word's beginning that make a term of their own, so inflected forms share what is learned.
STEM = 6


def terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each row's text: its distinct words and their stems. Every row has bucket 0."""
    ids, sizes = [], []
    for chunk in chunks(batch.column("text")):
        starts, ends, rows = words(chunk, MARKS)
        h = Hashes(LOWER[chunk.data])
        spread = np.uint64(fm.BUCKETS - 1)
        whole = h.of(starts, ends) % spread
        stem = (h.of(starts, np.minimum(ends, starts + STEM)) ^ np.uint64(0x5BD1E995)) % spread
        keys = np.concatenate([np.arange(chunk.rows) * fm.BUCKETS, np.tile(rows * fm.BUCKETS, 2) + 1 + np.concatenate([whole, stem]).astype(np.int64)])
        keys = np.unique(keys)
        ids.append(keys % fm.BUCKETS)
        sizes.append(np.bincount(keys // fm.BUCKETS, minlength=chunk.rows))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.cumsum(size) - size


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = fm.MOST_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of (doc_id, text), learned from labels (doc_id, toxic).

    Null and empty texts have no terms and get the score of a document that says nothing. Repeated rows are scored each.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = fm.train(docs, labels.select(F.col("doc_id").cast("long"), F.col("toxic").alias("label")), terms, most_rows)
    return fm.predictions(docs, model, terms, threshold)
