"""Centroid clustering by a dual-tree Lloyd: cover trees over blocks of vectors, a cover tree over the centroids of each round.

Each task builds a cover tree over the vectors of a block, once; the blocks with their trees are written to the shared folder
and read in every round. A round broadcasts the centroids (k times the dimension, whatever the number of vectors) and walks
pairs of nodes. A node of vectors keeps the centroid nodes that may hold the nearest centroid of any of its vectors; those
farther than the bound go, and the coarser node of a pair is split. Where one centroid is left, the whole node is assigned to
it and adds its stored sum, without a look at its vectors. What reaches leaves is compared exactly. Only sums by centroid and
component leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, settle
from tidemark.llm.vector_blocks import BLOCK, exact_kind, in_blocks, longs, packed_longs, squared, whole

CLUSTERS, ROUNDS, DIM, SEED = 40, 5, 64, 2
#: A node with so many vectors isn't split.
LEAF = 16
#: Children with so few vectors stay with their parent, where they are compared one by one.
LOOSE = 2

BLOCKS = "n int, ids binary, there binary, vectors binary, tree binary, nodes int"


@dataclass
class Tree:
    """A cover tree over rows that stand in the order of its nodes.

    Node i holds rows lo[i] to hi[i], all within radius[i] of its centre, row lo[i]. Its children are nodes first[i] to
    last[i] and hold rows lo[i] to loose[i]; the rest are its own. Centres of siblings are more than half their parent's
    radius apart, and the first child has its parent's centre.
    """

    lo: np.ndarray
    loose: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray
    radius: np.ndarray

    def packed(self) -> bytes:
        return np.stack([*(a.astype("<f8") for a in (self.lo, self.loose, self.hi, self.first, self.last)), self.radius]).tobytes()

    @staticmethod
    def unpacked(data: bytes, nodes: int) -> Tree:
        table = np.frombuffer(data, "<f8").reshape(6, nodes)
        return Tree(*table[:5].astype(np.int64), table[5])


def cover_tree(x: np.ndarray, leaf: int = LEAF, loose: int = LOOSE) -> tuple[Tree, np.ndarray]:
    """A cover tree over the rows of x, and the order in which they stand in it. A node of radius 0 isn't split."""
    x = x.astype(np.float64)
    order = np.arange(len(x))
    nodes = [[0, len(x), len(x), 0, 0, 0.0]] if len(x) else []  # lo, loose, hi, first, last, radius
    for node in nodes:
        lo, _, hi = node[:3]
        rows = order[lo:hi]
        away = np.sqrt(((x[rows] - x[rows[0]]) ** 2).sum(axis=1))
        node[5] = float(away.max()) * (1 + 1e-12)
        if hi - lo <= leaf or node[5] == 0:
            node[1] = lo
            continue
        half, groups, rest = node[5] / 2, [], rows
        while len(rest):
            near = away <= half
            near[0] = True
            groups.append(rest[near])
            rest = rest[~near]
            if len(rest):
                away = np.sqrt(((x[rest] - x[rest[0]]) ** 2).sum(axis=1))
        large = groups[:1] + [g for g in groups[1:] if len(g) > loose]  # the centre stays in front
        order[lo:hi] = np.concatenate(large + [g for g in groups[1:] if len(g) <= loose])
        node[3] = len(nodes)
        at = lo
        for g in large:
            nodes.append([at, at + len(g), at + len(g), 0, 0, 0.0])
            at += len(g)
        node[1], node[4] = at, len(nodes)
    table = np.array(nodes, np.float64).reshape(-1, 6).T
    return Tree(*table[:5].astype(np.int64), table[5]), order


class Centroids:
    """A round's centroids under a cover tree whose leaves are single centroids, or equal ones."""

    def __init__(self, centroids: np.ndarray):
        self.tree, order = cover_tree(centroids, leaf=1, loose=0)
        self.numbers, self.values = order, centroids[order]
        self.points = self.values.astype(np.float64)
        self.smallest = np.array([order[a:b].min() for a, b in zip(self.tree.lo, self.tree.hi, strict=True)], np.int64)

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """Places of all centroids below the nodes, the smallest number first."""
        at = np.concatenate([np.arange(self.tree.lo[i], self.tree.hi[i]) for i in nodes])
        return at[np.argsort(self.numbers[at])]

    def children(self, nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.tree.first[i], self.tree.last[i]) for i in nodes])


def near_nodes(c: Centroids, centre: np.ndarray, radius: float, nodes: np.ndarray) -> np.ndarray:
    """Of the centroid nodes, or of nodes below them, those that may hold the nearest centroid of a vector within radius of centre; ties are kept."""
    while True:
        away = np.sqrt(((c.points[c.tree.lo[nodes]] - centre) ** 2).sum(axis=1))
        least = away.min()
        kept = away - c.tree.radius[nodes] - radius <= (least + radius) * (1 + 1e-9) + 1e-6
        nodes = nodes[kept]
        wide = (c.tree.radius[nodes] > 0) & (c.tree.radius[nodes] >= radius)
        if not wide.any():
            return nodes
        nodes = np.concatenate([nodes[~wide], c.children(nodes[wide])])


def assign(x: np.ndarray, tree: Tree, c: Centroids) -> Iterator[tuple[int, int, int | np.ndarray, np.ndarray | None]]:
    """Pieces (lo, hi, number, None) whose rows all go to one centroid, and (lo, hi, numbers, squared distances) of rows compared one by one."""
    kind = exact_kind(x, c.values)
    stack = [(0, np.zeros(1, np.int64))] if len(x) else []
    while stack:
        q, nodes = stack.pop()
        lo, loose, hi = tree.lo[q], tree.loose[q], tree.hi[q]
        nodes = near_nodes(c, x[lo].astype(np.float64), tree.radius[q], nodes)
        if len(nodes) == 1 and c.tree.radius[nodes[0]] == 0:
            yield lo, hi, c.smallest[nodes[0]], None
            continue
        if loose < hi:
            at = c.below(nodes)
            d2 = squared(x[loose:hi].astype(kind), c.values[at].astype(kind))
            best = d2.argmin(axis=1)
            yield loose, hi, c.numbers[at[best]], d2[np.arange(hi - loose), best].astype(np.int64)
        stack += [(i, nodes) for i in range(tree.first[q], tree.last[q])]


def _unpacked(r) -> tuple[np.ndarray, Tree]:
    return np.frombuffer(r.vectors, "<i4").reshape(r.n, -1).astype(np.int64), Tree.unpacked(r.tree, r.nodes)


def _blocks(rows: DataFrame, dim: int, most: int) -> DataFrame:
    def make(found: pd.DataFrame, x: np.ndarray) -> tuple:
        tree, order = cover_tree(x)
        return len(x), *packed_longs(found["vec_id"].iloc[order]), x[order].astype("<i4").tobytes(), tree.packed(), len(tree.lo)

    return in_blocks(rows, dim, make, BLOCKS, most)


def _sums(blocks: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each centroid gets, and the sum of their components."""
    k, dim = centroids.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, n, total = Centroids(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for r in batch.itertuples(index=False):
                x, tree = _unpacked(r)
                running = np.concatenate([np.zeros((1, dim), np.int64), np.cumsum(x, axis=0)])
                for lo, hi, numbers, away in assign(x, tree, c):
                    if away is None:
                        n[numbers] += hi - lo
                        total[numbers] += running[hi] - running[lo]
                    else:
                        np.add.at(n, numbers, 1)
                        np.add.at(total, numbers, x[lo:hi])
        used = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": np.repeat(used, dim), "place": np.tile(np.arange(dim), len(used)), "n": np.repeat(n[used], dim), "total": total[used].ravel()})

    parts = blocks.mapInPandas(run, "cluster int, place int, n long, total long")
    n, total = np.zeros(k, object), np.zeros((k, dim), object)
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # k times dim rows at most
        n[r.cluster], total[r.cluster, r.place] = r.n, int(r.total)
    return n, total


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Centroids(centroids)
        for batch in batches:
            for r in batch.itertuples(index=False):
                x, tree = _unpacked(r)
                number, distance = np.zeros(r.n, np.int64), np.zeros(r.n, np.int64)
                for lo, hi, numbers, away in assign(x, tree, c):
                    number[lo:hi] = numbers
                    distance[lo:hi] = ((x[lo:hi] - centroids[numbers]) ** 2).sum(axis=1) if away is None else away
                yield pd.DataFrame({"vec_id": longs(r.ids, r.there), "cluster": number, "distance": distance})

    return blocks.mapInPandas(run, "vec_id long, cluster int, distance long")


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the k smallest digests of "<seed>:<vec_id>"; rows of one digest stand by their vectors, rows without a vec_id are none."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").select(digest.alias("digest"), "parts").orderBy("digest", "parts").limit(k).collect()  # k rows
    return np.array([r.parts for r in first], np.int64)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, most: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector; the final centroids).

    vectors has vec_id and embedding; other columns are passed over. Vectors that are null, hold null or non-finite
    components or have another number of components than dim are left out; components count as floor(256 * x), within 2^26
    of 0. Each row is a vector: repeated rows and repeated vec_ids count as often, and rows without a vec_id are assigned
    but never start a centroid. Fewer than k rows with a vec_id make fewer centroids, and none make an empty result. Ties go
    to the centroid with the smaller number; equal centroids are such a tie. A centroid that gets no vector stays where it is.
    """
    rows = whole(vectors).where(F.size("parts") == dim)
    centroids = seeds(rows, k, seed)
    if not len(centroids):
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema), centroids.reshape(0, dim)
    blocks = settle(_blocks(rows, dim, most), "vectors")
    for _ in range(rounds):
        n, total = _sums(blocks, centroids)
        for i in np.flatnonzero(n):
            centroids[i] = [t // n[i] for t in total[i]]
    out = settle(_assigned(blocks, centroids), "clusters")
    drop(blocks)
    spread = {r.cluster: int(r.inertia) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole_spread = min(sum(spread.values()), 2**63 - 1)
    told = vectors.sparkSession.createDataFrame([(i, min(spread.get(i, 0), 2**63 - 1), whole_spread, digest[i]) for i in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
