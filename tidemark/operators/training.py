"""Data-parallel training of sequence networks: batches, gradients, early stopping and committed epochs.

An epoch deals all users into batches by a seeded permutation, packs their tensors in units of a fixed number of users and
writes them by batch. A step is one job over a batch: each task sums the gradients of its units, and the sums are added up a tree of
FAN branches. A unit's rows are fixed by the permutation and gradients are summed as whole numbers (2^-32), so weights don't
depend on partitions. The driver holds the weights and the state of Adam alone; each epoch is committed to a folder by one rename,
from which a stopped run goes on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators.networks import Network
from tidemark.sources.shared import children, drop, rename, settle

#: Users in a unit, whose rows meet in one group.
UNIT = 256
#: Sums of gradients that meet in one group.
FAN = 16
GRAIN = float(1 << 32)
UNITS = "batch int, unit long, n int, days int, tensors binary, targets binary"


def dealt(users: DataFrame, batches: int | None = None, size: int | None = None, epoch: int = 0, seed: int = 0, buckets: int = 256) -> DataFrame:
    """user_id, place, batch: a permutation of the users that depends on seed and epoch alone, dealt into batches.

    Give the number of batches, or the size that none exceeds. Sizes differ by one at most, and each user (user_id, once) is in one batch.
    Users are ranked within buckets of their hash, and a bucket starts where those before it end, so nothing is sorted as a
    whole; the driver sees the sizes of the buckets, which should hold some hundred thousand users each at most.
    """
    mixed = users.select("user_id", F.xxhash64(F.lit(seed), F.lit(epoch), "user_id").alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    counts = {r.bucket: r["count"] for r in mixed.groupBy("bucket").count().collect()}
    total = sum(counts.values())
    batches = max(1, batches or -(-total // size))
    starts = np.cumsum([0, *(counts.get(b, 0) for b in range(buckets))])[:-1].tolist()
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "user_id")) - 1
    place = (F.element_at(F.lit(starts), F.col("bucket") + 1) + rank).cast("long")
    return mixed.select("user_id", place.alias("place")).withColumn("batch", (F.col("place") % batches).cast("int"))


def packed(tensors: DataFrame, places: DataFrame, unit: int = UNIT) -> DataFrame:
    """Units of (user_id, tensor, target) rows by batch, in the order of places; written by batch, so that a step reads only its own."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        x = np.stack(rows["tensor"]).astype("<f4")
        return pd.DataFrame([(key[0], key[1], len(rows), rows["days"].iloc[0], x.tobytes(), rows["target"].to_numpy("<f8").tobytes())], columns=[c.split()[0] for c in UNITS.split(", ")])

    dealt_out = places.agg(F.max("batch").alias("last"), F.count("*").alias("n")).first()
    batches = (dealt_out["last"] or 0) + 1
    # files that a step can read at once: one or two for each core, more of a batch with many units; small tables would end up in one
    each = -(-dealt_out["n"] // (batches * unit))
    files = max(1, min(each, max(2 * places.sparkSession.sparkContext.defaultParallelism, each // 32)))
    # one flat list a row, as lists of lists become an object for each day
    met = tensors.select("user_id", F.flatten("tensor").alias("tensor"), F.size("tensor").alias("days"), F.col("target").cast("double").alias("target")).join(places, "user_id")
    return met.withColumn("unit", F.floor(F.floor(F.col("place") / batches) / unit)).repartition(files, "unit").groupBy("batch", "unit").applyInPandas(pack, UNITS)


def unpacked(r) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r.tensors, "<f4").reshape(r.n, r.days, -1).astype(np.float64), np.frombuffer(r.targets, "<f8")


def summed(units: DataFrame, network: Network, weights: np.ndarray, with_gradient: bool = True) -> tuple[int, float, np.ndarray]:
    """(rows, mean squared error, mean gradient) over units; the sums of tasks are added up a tree."""
    size = network.size if with_gradient else 0

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for r in batch.itertuples(index=False):
                x, y = unpacked(r)
                if with_gradient:
                    loss, gradient = network.gradient(weights, x, y)
                    total[2:] += np.rint(gradient * GRAIN).astype(np.int64)
                else:
                    loss = float(((network.predict(weights, x) - y) ** 2).sum())
                total[0] += r.n
                total[1] += int(round(loss * GRAIN))
        yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "total": [total.tobytes()]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"task": [key[0]], "total": [np.sum([np.frombuffer(t, "<i8") for t in rows["total"]], axis=0).tobytes()]})

    parts, left = units.mapInPandas(own, "task long, total binary"), units.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.groupBy((F.col("task") % left).alias("task")).applyInPandas(add, "task long, total binary")
    total = np.sum([np.zeros(size + 2, np.int64), *(np.frombuffer(r.total, "<i8") for r in parts.collect())], axis=0)  # FAN rows at most
    n = int(total[0])
    return n, total[1] / GRAIN / max(1, n), total[2:] / GRAIN / max(1, n)


@dataclass
class State:
    """Weights with Adam's moments, after so many epochs; and what was best by validation loss."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0
    epoch: int = 0
    best: np.ndarray | None = None
    best_loss: float = float("inf")
    best_epoch: int = 0
    train_loss: float = float("nan")
    valid_loss: float = float("nan")

    @staticmethod
    def new(weights: np.ndarray) -> State:
        return State(weights, np.zeros_like(weights), np.zeros_like(weights), best=weights)

    def advance(self, gradient: np.ndarray, rate: float, clip: float, decay: tuple[float, float] = (0.9, 0.999)) -> None:
        """A step of Adam on a gradient that is cut to a norm of clip."""
        norm = float(np.sqrt((gradient**2).sum()))
        g = gradient * min(1.0, clip / norm) if norm > 0 else gradient
        self.step += 1
        self.first = decay[0] * self.first + (1 - decay[0]) * g
        self.second = decay[1] * self.second + (1 - decay[1]) * g * g
        self.weights = self.weights - rate * (self.first / (1 - decay[0] ** self.step)) / (np.sqrt(self.second / (1 - decay[1] ** self.step)) + 1e-8)


class Epochs:
    """Committed epochs in a folder: an epoch is there whole or not at all."""

    VECTORS, NUMBERS = ("weights", "first", "second", "best"), ("step", "epoch", "best_loss", "best_epoch", "train_loss", "valid_loss")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        return [int(n.removeprefix("epoch-")) for n in children(self.spark, self.path) if n.startswith("epoch-")]

    def commit(self, state: State) -> None:
        row = [bytearray(getattr(state, n).astype("<f8").tobytes()) for n in self.VECTORS] + [float(getattr(state, n)) for n in self.NUMBERS]
        schema = ", ".join([f"{n} binary" for n in self.VECTORS] + [f"{n} double" for n in self.NUMBERS])
        unnamed = f"{self.path}/new-{uuid.uuid4().hex}"
        self.spark.createDataFrame([tuple(row)], schema).coalesce(1).write.parquet(unnamed)
        if not rename(self.spark, unnamed, f"{self.path}/epoch-{state.epoch:06d}"):
            raise ValueError(f"epoch {state.epoch} is committed already: another run writes to {self.path}")

    def load(self, epoch: int) -> State:
        r = self.spark.read.parquet(f"{self.path}/epoch-{epoch:06d}").first()
        numbers = {n: int(r[n]) if n in ("step", "epoch", "best_epoch") else r[n] for n in self.NUMBERS}
        return State(**{n: np.frombuffer(bytes(r[n]), "<f8").copy() for n in self.VECTORS}, **numbers)

    def losses(self) -> DataFrame:
        """epoch, train_loss, valid_loss of all committed epochs."""
        return self.spark.read.parquet(*[f"{self.path}/epoch-{n:06d}" for n in self.numbers()]).select(F.col("epoch").cast("int").alias("epoch"), "train_loss", "valid_loss")


def fit(network: Network, train: DataFrame, valid: DataFrame | None = None, epochs: int = 10, batch: int = 4096, batches: int | None = None, rate: float = 0.001, clip: float = 1.0, patience: int = 3, seed: int = 0, unit: int = UNIT, store: Epochs | None = None, stop: Callable[[State], bool] = lambda s: False) -> State:
    """The state after training on rows of (user_id, tensor, target), each user once; best holds the weights to use.

    An epoch has so many batches, or batches of at most batch users where their number isn't given: a step is a job, so a large
    table wants large batches. The loss is the mean squared error. With validation rows the best epoch is that of the least validation loss, and training
    ends after patience epochs without a better one; without, it is the last. With a store, each epoch is committed and a
    run goes on after the last one that is. stop(state) after an epoch ends the run. Without rows the network stays as it was.
    """
    state = State.new(network.start(seed))
    if store and store.numbers():
        state = store.load(store.numbers()[-1])
    held = settle(packed(valid, dealt(valid, 1, seed=seed), unit), "valid") if valid is not None else None
    while state.epoch < epochs and (held is None or state.epoch - state.best_epoch < patience):
        places = settle(dealt(train, batches, batch, epoch=state.epoch, seed=seed), "places")
        units = settle(packed(train, places, unit), "units", "batch")
        steps, seen, loss = (places.agg(F.max("batch")).first()[0]), 0, 0.0
        for b in range(0 if steps is None else steps + 1):
            n, error, gradient = summed(units.where(F.col("batch") == b), network, state.weights)
            seen, loss = seen + n, loss + error * n
            state.advance(gradient, rate, clip)
        drop(units, places)
        state.epoch, state.train_loss = state.epoch + 1, loss / max(1, seen)
        if held is not None:
            state.valid_loss = summed(held, network, state.weights, with_gradient=False)[1]
        if held is None or state.valid_loss < state.best_loss:
            state.best, state.best_epoch, state.best_loss = state.weights.copy(), state.epoch, state.valid_loss
        if store:
            store.commit(state)
        if stop(state):
            break
    if held is not None:
        drop(held)
    return state


def predict(network: Network, weights: np.ndarray, rows: DataFrame, name: str = "prediction") -> DataFrame:
    """rows of any columns with a tensor, and a prediction for each in place of it."""
    kept = [f for f in rows.schema if f.name != "tensor"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), UNIT):
                b = batch.iloc[lo : lo + UNIT]
                x = np.stack(b["tensor"]).reshape(len(b), b["_days"].iloc[0], -1).astype(np.float64)
                yield b.drop(columns=["tensor", "_days"]).assign(**{name: network.predict(weights, x)})

    return rows.withColumns({"tensor": F.flatten("tensor"), "_days": F.size("tensor")}).mapInPandas(run, StructType([*kept, StructField(name, DoubleType())]))


def out_of_fold(network: Network, rows: DataFrame, snapshots: list[str], first: int = 1, name: str = "residual_prediction", **options) -> DataFrame:
    """user_id, snapshot_name, fold and a prediction for each snapshot from the first on, by a network that has seen the earlier ones alone.

    rows: user_id, snapshot_name, tensor, target. A user of several snapshots is a row of each. Each tenth user, by a hash, of the
    earlier snapshots stops the training.
    """
    out = None
    for fold, at in enumerate(range(first, len(snapshots)), 1):
        own = F.xxhash64("user_id", "snapshot_name")
        before = rows.where(F.col("snapshot_name").isin(snapshots[:at])).withColumn("_held", F.pmod(F.xxhash64("user_id"), F.lit(10)) == 0)
        before = before.select(own.alias("user_id"), "tensor", "target", "_held")
        state = fit(network, before.where(~F.col("_held")), before.where("_held"), **options)
        part = predict(network, state.best, rows.where(F.col("snapshot_name") == snapshots[at]).select("user_id", "snapshot_name", "tensor"), name).withColumn("fold", F.lit(fold))
        out = part if out is None else out.unionByName(part)
    return out
