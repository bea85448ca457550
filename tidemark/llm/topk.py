"""Exact top-k search by inner product: columnar branch and bound over blocks of vectors.

Vectors are packed into blocks in a vertical layout (a row of the matrix is a dimension). Candidates stay where they were
packed: queries are dealt over rounds of at most ROUND numbers, and in each round all candidates are read once, with the
round's queries broadcast. So nothing is shuffled but the best few of each task, and what a task holds doesn't grow with
either table. For a pair of blocks, products are summed a few dimensions at a time. What the dimensions to come can add is
bounded by the product of the remaining masses (Cauchy-Schwarz). A candidate whose bound falls below the k-th best lower
bound is dropped, and the survivors are compacted before the next dimensions. A task's floors rise from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import gather, settle

K = 5
SCALE = 256
#: Numbers in a block; it has at least one vector.
BLOCK = 1 << 18
#: Numbers of all queries of a round, of eight bytes each; this much is broadcast.
ROUND = 1 << 22
#: Dimensions that are summed before candidates are dropped.
STRIDE = 16

BLOCKS = "dim int, n int, ids binary, parts binary"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and parts (floor(scale * x) of each component) of the vectors that take part.

    Vectors that are null or hold null or non-finite components take none.
    """
    x = F.col("embedding")
    sound = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(sound).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("parts"))


def blocks(parts: DataFrame, most: int = BLOCK) -> DataFrame:
    """Vectors (vec_id, parts) in blocks, each of one dimension. A task packs what it reads, so nothing is shuffled."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, rows = zip(*held.pop(dim), strict=True)
            return pd.DataFrame([(dim, len(ids), np.array(ids, "<i8").tobytes(), np.array(rows, "<i8").reshape(len(ids), dim).T.tobytes())], columns=["dim", "n", "ids", "parts"])

        for batch in batches:
            for vec_id, row in zip(batch["vec_id"], batch["parts"], strict=True):
                held.setdefault(len(row), []).append((vec_id, row))
                if len(held[len(row)]) >= max(1, most // max(1, len(row))):
                    yield block(len(row))
        for dim in list(held):
            yield block(dim)

    return parts.mapInPandas(pack, BLOCKS)


def _unpack(dim: int, n: int, ids: bytes, parts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(parts, "<i8").reshape(dim, n)


def _masses(x: np.ndarray, stride: int) -> np.ndarray:
    """By stride, the length of what each vector has beyond it."""
    squares = np.add.reduceat(x.astype(np.float64) ** 2, np.arange(0, len(x), stride), axis=0) if len(x) else np.zeros((0, x.shape[1]))
    return np.sqrt(np.maximum(np.cumsum(squares[::-1], axis=0)[::-1] - squares, 0))


def branch_and_bound(queries: tuple, candidates: tuple, floors: np.ndarray, k: int = K, stride: int = STRIDE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query that has any: its number, and vec_ids and scores of its best k candidates, unless below its floor.

    Candidates with the query's own vec_id are passed over. Ties go to the smaller vec_id. floors are scores that a
    query's k-th result is known to reach; they are raised as better ones are found.
    """
    (q_ids, q), (c_ids, c) = queries, candidates
    order = np.argsort(c_ids)
    c_ids, c = c_ids[order], c[:, order]
    wide = max(1.0, float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, len(q)))
    exact = np.float64 if wide < 2**52 else np.int64  # whole numbers either way
    q, c = q.astype(exact), c.astype(exact)
    q_mass, c_mass = _masses(q, stride), _masses(c, stride)
    for i in range(len(q_ids)):
        alive = np.flatnonzero(c_ids != q_ids[i])
        sums = np.zeros(len(alive), exact)
        for b, lo in enumerate(range(0, len(q), stride)):
            sums = sums + q[lo : lo + stride, i] @ c[lo : lo + stride, alive]
            slack = q_mass[b, i] * c_mass[b, alive] * (1 + 1e-9) + 1e-3
            floor = floors[i]
            if len(alive) >= k:
                floor = max(floor, np.partition(sums - slack, len(alive) - k)[len(alive) - k])
            kept = sums + slack >= floor
            if not kept.all():
                alive, sums = alive[kept], sums[kept]
        best = np.lexsort((alive, -sums))[:k]
        if len(best):
            if len(best) == k:
                floors[i] = max(floors[i], sums[best[-1]])
            yield i, c_ids[alive[best]], sums[best].astype(np.int64)


def _dealt(queries: DataFrame, block: int, most: int) -> tuple[DataFrame, int]:
    """The queries (vec_id, parts) in blocks with the round of each, and how many rounds there are."""
    numbers = queries.agg(F.sum(F.greatest(F.size("parts"), F.lit(1)))).first()[0] or 0
    rounds = -(-numbers // most)
    # even rounds, however often a vec_id is repeated
    dealt = blocks(queries.repartition(max(1, rounds)), block).withColumn("round", F.spark_partition_id())
    return settle(dealt, "queries"), rounds


def _nearest(candidates: DataFrame, asked: Broadcast, k: int, stride: int) -> DataFrame:
    """query, query_id, vec_id, score of the best of each task for the broadcast blocks of queries. query numbers the queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[int, np.ndarray] = {}
        unpacked = [_unpack(*block) for block in asked.value]
        first = np.cumsum([0] + [len(ids) for ids, _ in unpacked])
        for batch in batches:
            for r in batch.itertuples(index=False):
                offered = _unpack(r.dim, r.n, r.ids, r.parts)
                for b, (ids, q) in enumerate(unpacked):
                    if len(q) != r.dim:
                        continue
                    found = list(branch_and_bound((ids, q), offered, floors.setdefault(b, np.full(len(ids), -np.inf)), k, stride))
                    if found:
                        at, sizes = np.array([i for i, _, _ in found]), [len(v) for _, v, _ in found]
                        yield pd.DataFrame({"query": np.repeat(first[b] + at, sizes), "query_id": np.repeat(ids[at], sizes), "vec_id": np.concatenate([v for _, v, _ in found]), "score": np.concatenate([x for _, _, x in found])})

    return candidates.select("dim", "n", "ids", "parts").mapInPandas(run, "query long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, block: int = BLOCK, stride: int = STRIDE, most: int = ROUND) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors with the highest integer inner product for each query.

    Both tables have vec_id and embedding; other columns are passed over. A vector is no result for a query of its own vec_id;
    vectors of another dimension are none either. A query with fewer candidates gets all; ties go to the smaller vec_id. Scores
    are 64-bit. Each row of queries is a query and each row of vectors a candidate, repeated vec_ids too. Empty tables give
    an empty one.
    """
    c = settle(blocks(quantised(vectors, scale), block), "candidates")
    q, rounds = _dealt(quantised(queries, scale), block, most)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))

    def best(number: int) -> DataFrame:
        rows = q.where(F.col("round") == number).select("dim", "n", "ids", "parts").collect()  # at most a round
        near = _nearest(c, vectors.sparkSession.sparkContext.broadcast([tuple(r) for r in rows]), k, stride)
        return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    return gather(vectors.sparkSession, (best(i) for i in range(rounds)), "query_id long, rank int, vec_id long, score long", "nearest")
