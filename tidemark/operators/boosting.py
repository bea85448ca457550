"""Gradient boosting over distributed histograms.

Features are cut into bins once, at quantiles; rows are packed in blocks of binary columns and written to the shared folder.
A level of a tree is one job: each task sums gradients, second derivatives and counts by (node, feature, bin) over its blocks,
Spark adds the sums by cell, and the cells alone reach the driver (nodes times features times bins), which chooses the splits.
Of two siblings the histogram of one is summed, that of the other is the parent's less it. Sums are whole numbers (2^-20), so trees do
not depend on partitions or on the order of addition. Margins of rows are kept with the blocks and written anew every REFRESH
trees; in between, the trees since then are applied in the same pass.

Trees grow symmetric (one split for all nodes of a level) or leaf by leaf (the leaf with the best gain is split next).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.sources.shared import drop, settle

#: Sums are in units of 1 / UNIT.
UNIT = 1 << 20
#: Rows in a block.
BLOCK = 1 << 15
#: Trees after which margins are written anew.
REFRESH = 8
BLOCKS = "n int, bins binary, target binary, weight binary, valid binary, margin binary"


@dataclass(frozen=True)
class Options:
    """loss is "squared" (of the target as it is) or "logistic" (of a target of 0 or 1); grow is "symmetric" or "leaf"."""

    loss: str = "squared"
    grow: str = "symmetric"
    trees: int = 100
    depth: int = 4
    leaves: int = 16
    rate: float = 0.1
    l2: float = 1.0
    least_rows: int = 1
    bins: int = 64
    patience: int = 150


@dataclass
class Tree:
    """Node i sends rows whose bin of feature[i] is at most bin[i] to left[i], others to right[i]; a leaf has feature -1 and a value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, cut, at, at + 1
        for column, x in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [x, x]
        return at, at + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins (rows by features)."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return node
            goes = bins[rows, np.maximum(feature[node], 0)] <= cut[node]
            node = np.where(inner, np.where(goes, left[node], right[node]), node)

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Model:
    features: list[str]
    cuts: list[np.ndarray]
    options: Options
    start: float
    trees: list[Tree]
    losses: list[tuple[float, float | None]]
    #: Gain of all splits by feature.
    gains: np.ndarray
    #: Cells that the driver read at most for one level.
    most_cells: int = 0

    @property
    def best(self) -> int:
        """Trees up to the least validation loss; all without validation rows."""
        valid = [v for _, v in self.losses]
        return len(self.trees) if None in valid else int(np.argmin(valid))

    def importance(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, self.gains.tolist(), strict=True), key=lambda x: (-x[1], x[0]))

    def predict(self, rows: DataFrame, name: str = "prediction", trees: int | None = None) -> DataFrame:
        """rows with a prediction: the probability for the logistic loss, else the value."""
        used = self.trees[: self.best if trees is None else trees]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                b = binned(batch[self.features].to_numpy(np.float64), self.cuts)
                margin = np.full(len(batch), self.start)
                for t in used:
                    margin += self.options.rate * t.values(b)
                yield batch.assign(**{name: 1 / (1 + np.exp(-margin)) if self.options.loss == "logistic" else margin})

        return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def quantile_cuts(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Cut points of each feature at its quantiles, equal ones once; bins times features numbers reach the driver."""
    shares = F.array(*[F.lit(i / (bins - 1)) for i in range(1, bins - 1)])
    found = rows.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), shares, 100_000).alias(f) for f in features]).first()
    return [np.unique(np.array(x or [], np.float64)) for x in found]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: 0 for a missing one, else 1 and the number of cuts below it."""
    return np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(c, v, "left")) for v, c in zip(values.T, cuts, strict=True)], axis=1).astype(np.uint8)


def derivatives(loss: str, target: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, first and second derivative of each row."""
    if loss == "squared":
        return (margin - target) ** 2, margin - target, np.ones_like(margin)
    p = 1 / (1 + np.exp(-margin))
    return np.logaddexp(0, margin) - target * margin, p - target, p * (1 - p)


def histograms(bins: np.ndarray, node: np.ndarray, asked: list[int], sums: np.ndarray, width: int) -> np.ndarray:
    """Sums (a row of three whole numbers by row of bins) by asked node, feature and bin."""
    place = np.full(max(int(node.max(initial=0)), *asked) + 1, -1)
    place[asked] = np.arange(len(asked))
    at = place[node]
    rows = at >= 0
    out = np.zeros((len(asked), bins.shape[1], width, 3), np.int64)
    for f in range(bins.shape[1]):
        cell = at[rows] * width + bins[rows, f]
        for k in range(3):
            out[:, f, :, k] = np.bincount(cell, sums[rows, k], len(asked) * width).reshape(len(asked), width)  # exact: below 2^53 in a block
    return out


def gains(h: np.ndarray, l2: float, least_rows: int) -> np.ndarray:
    """The gain of splitting each node by each feature after each bin; below any other where a side has too few rows."""
    left = np.cumsum(h, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    score = lambda s: (s[..., 0] / UNIT) ** 2 / (s[..., 1] / UNIT + l2)
    gain = score(left) + score(right) - score(total)
    return np.where((left[..., 2] >= least_rows) & (right[..., 2] >= least_rows), gain, -np.inf)


def best_split(gain: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a table by feature and bin; ties to the smaller feature, then bin."""
    at = int(gain.argmax())
    return float(gain.flat[at]), *np.unravel_index(at, gain.shape)


def _blocks(rows: DataFrame, features: list[str], cuts: list[np.ndarray], target: str, weight: str | None, valid: str | None, start: float) -> DataFrame:
    asked = rows.select(*features, F.col(target).cast("double").alias("_target"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_weight"), F.coalesce(F.col(valid) if valid else F.lit(False), F.lit(False)).alias("_valid"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                b = batch.iloc[lo : lo + BLOCK]
                bins = binned(b[features].to_numpy(np.float64), cuts)
                held = (b["_target"].to_numpy("<f8"), b["_weight"].to_numpy("<f8"), b["_valid"].to_numpy("u1"), np.full(len(b), start, "<f8"))
                yield pd.DataFrame([(len(b), bins.tobytes(), *(x.tobytes() for x in held))], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return asked.where("_target is not null").mapInPandas(run, BLOCKS)


class _Rows:
    """A block, with the margins after the trees since it was written."""

    def __init__(self, r, pending: list[Tree], rate: float):
        self.bins = np.frombuffer(r.bins, np.uint8).reshape(r.n, -1)
        self.target, self.weight, self.valid = np.frombuffer(r.target, "<f8"), np.frombuffer(r.weight, "<f8"), np.frombuffer(r.valid, "u1").astype(bool)
        self.margin = np.frombuffer(r.margin, "<f8").copy()
        for t in pending:
            self.margin += rate * t.values(self.bins)


def _level(blocks: DataFrame, pending: list[Tree], tree: Tree, asked: list[int], o: Options, width: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Histograms of the asked nodes of a tree that is being grown, and (loss, weight) of training and validation rows before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, losses = np.zeros((len(asked), features, width, 3), np.int64), np.zeros(4, np.int64)
        for batch in batches:
            for r in batch.itertuples(index=False):
                rows = _Rows(r, pending, o.rate)
                loss, g, h = derivatives(o.loss, rows.target, rows.margin)
                for k, mask in enumerate((~rows.valid, rows.valid)):
                    losses[2 * k : 2 * k + 2] += [int(np.rint(loss * rows.weight * UNIT)[mask].sum()), int(np.rint(rows.weight * UNIT)[mask].sum())]
                learned = ~rows.valid
                sums = np.stack([np.rint(g * rows.weight * UNIT), np.rint(h * rows.weight * UNIT), np.ones(r.n)], axis=1)[learned]
                total += histograms(rows.bins[learned], tree.leaves(rows.bins[learned]), asked, sums, width)
        flat = np.concatenate([losses, total.ravel()])
        cells = np.flatnonzero(flat)
        yield pd.DataFrame({"cell": cells, "total": flat[cells]})

    flat = np.zeros(4 + len(asked) * features * width * 3, object)
    for r in blocks.mapInPandas(run, "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total")).collect():
        flat[r.cell] = r.total
    flat = flat.astype(np.int64)
    return flat[4:].reshape(len(asked), features, width, 3), flat[:4]


def _refreshed(blocks: DataFrame, pending: list[Tree], rate: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(margin=[_Rows(r, pending, rate).margin.tobytes() for r in batch.itertuples(index=False)])

    return blocks.mapInPandas(run, BLOCKS)


def _grow(level, o: Options, width: int, features: int, gained: np.ndarray) -> tuple[Tree, np.ndarray, int]:
    """(a tree, the losses before it, the most cells of a level); level(tree, asked nodes) gives their histograms."""
    tree = Tree()
    h, losses = level(tree, [0])
    known, most = {0: h[0]}, h.size

    def children(splits: list[tuple[int, int, int]]) -> None:
        """Splits nodes; of each pair the child with fewer rows is summed over the blocks, the other is what is left."""
        nonlocal most
        fewer, pairs = [], []
        for node, f, cut in splits:
            left, right = tree.split(node, f, cut)
            rows = known[node][f, :, 2]
            one, other = (left, right) if 2 * rows[: cut + 1].sum() <= rows.sum() else (right, left)
            fewer.append(one)
            pairs.append((node, one, other))
        found, _ = level(tree, fewer)
        most = max(most, found.size)
        for (node, one, other), own in zip(pairs, found, strict=True):
            known[one], known[other] = own, known.pop(node) - own

    if o.grow == "symmetric":
        for _ in range(o.depth):
            nodes = sorted(known)
            each = gains(np.stack([known[n] for n in nodes]), o.l2, o.least_rows)
            # a node that the split leaves on one side gains nothing; the others decide
            total = np.where(np.isfinite(each), each, 0).sum(axis=0)
            total[~np.isfinite(each).any(axis=0)] = -np.inf
            gain, f, cut = best_split(total)
            if not gain > 1e-12:
                break
            gained[f] += gain
            children([(n, int(f), int(cut)) for n in nodes])
    else:
        depth = {0: 0}
        while len(known) < o.leaves:
            offers = {n: best_split(gains(h[None], o.l2, o.least_rows)[0]) for n, h in known.items() if depth[n] < o.depth}
            node = max(offers, key=lambda n: (offers[n][0], -n), default=None)
            if node is None or not offers[node][0] > 1e-12:
                break
            gain, f, cut = offers[node]
            gained[f] += gain
            children([(node, int(f), int(cut))])
            depth[tree.left[node]] = depth[tree.right[node]] = depth[node] + 1
    for n, h in known.items():
        g, s = h[0, :, 0].sum() / UNIT, h[0, :, 1].sum() / UNIT
        tree.value[n] = -g / (s + o.l2) if s + o.l2 > 0 else 0.0
    return tree, losses, most


def fit(rows: DataFrame, features: list[str], target: str = "target", weight: str | None = None, valid: str | None = None, options: Options | None = None) -> Model:
    """A boosted model of rows.

    weight names a column of row weights, valid a boolean one of rows that are not learned from but stop the boosting once
    options.patience trees bring no better loss; the model then predicts by the trees up to the best. Missing and undefined
    feature values have a bin of their own, below all others. Rows without a target are left out; without any rows to learn from,
    ValueError. Targets times weights up to some millions keep their sums within 64 bits for 10^9 rows.
    """
    o = options or Options()
    if not 3 <= o.bins <= 255:
        raise ValueError("bins must be from 3 to 255")
    learned = rows.where(F.col(target).isNotNull() & (~F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(True)))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    n, mean = learned.agg(F.count("*"), F.sum(F.rint(w * F.col(target) * UNIT).cast("long")) / F.sum(F.rint(w * UNIT).cast("long"))).first()
    if not n or mean is None:
        raise ValueError("no rows to learn from")
    start = float(mean) if o.loss == "squared" else float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6))))
    cuts = quantile_cuts(learned, features, o.bins)
    width = max(len(c) for c in cuts) + 2
    blocks = settle(_blocks(rows, features, cuts, target, weight, valid, start), "blocks")
    model = Model(features, cuts, o, start, [], [], np.zeros(len(features)))
    pending: list[Tree] = []

    def note(sums: np.ndarray) -> None:
        model.losses.append((sums[0] / max(1, sums[1]), sums[2] / sums[3] if sums[3] else None))

    for _ in range(o.trees):
        tree, losses, most = _grow(lambda t, asked: _level(blocks, pending, t, asked, o, width, len(features)), o, width, len(features), model.gains)
        note(losses)
        model.most_cells = max(model.most_cells, most)
        if model.losses[-1][1] is not None and len(model.losses) - 1 - int(np.argmin([v for _, v in model.losses])) >= o.patience:
            break
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) == REFRESH:
            before, blocks = blocks, settle(_refreshed(blocks, pending, o.rate), "blocks")
            pending.clear()
            drop(before)
    else:
        note(_level(blocks, pending, Tree(), [0], o, width, len(features))[1])
    drop(blocks)
    return model


def encoded_categories(rows: DataFrame, column: str, target: str, learn: str, prior: float = 10.0, folds: int = 8, seed: int = 7) -> DataFrame:
    """rows with <column>_mean: the mean target of the column's value in rows where learn holds, drawn to the mean of all by prior rows.

    A row that is learned from sees only the other folds of its value, so its own target never reaches its feature. Values
    that no other row has get the mean of all; so do nulls. Folds are dealt by a hash of the whole row.
    """
    fold = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns]), F.lit(folds)).cast("int")
    dealt = rows.withColumn("_fold", F.when(F.col(learn), fold))
    sums = dealt.where(F.col(learn) & F.col(target).isNotNull()).groupBy(column, "_fold").agg(F.sum(target).alias("_s"), F.count("*").alias("_n"))
    every = Window.partitionBy(column)  # folds rows a value
    of_value = sums.select(F.col(column).alias("_v"), F.col("_fold").alias("_f"), "_s", "_n", F.sum("_s").over(every).alias("_ts"), F.sum("_n").over(every).alias("_tn"))
    own = of_value.select("_v", "_f", (F.col("_ts") - F.col("_s")).alias("_s"), (F.col("_tn") - F.col("_n")).alias("_n"))
    others = of_value.select("_v", F.lit(None).cast("int").alias("_f"), F.col("_ts").alias("_s"), F.col("_tn").alias("_n")).distinct()
    mean = rows.where(F.col(learn)).agg(F.coalesce(F.avg(target), F.lit(0.0))).first()[0]
    t = own.unionByName(others)
    met = dealt.join(t, (F.col(column) == t["_v"]) & dealt["_fold"].eqNullSafe(t["_f"]), "left")
    value = (F.coalesce(F.col("_s"), F.lit(0.0)) + prior * mean) / (F.coalesce(F.col("_n"), F.lit(0)) + prior)
    return met.select(*rows.columns, value.alias(f"{column}_mean"))
