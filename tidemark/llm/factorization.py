"""A factorization machine over hashed features, fitted on a bounded sample and scored with Spark.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairs cost linear time by the sum-of-squares
identity: half of |sum_i v_i x_i|^2 - sum_i |v_i x_i|^2. A document's features are buckets that it does or doesn't have;
x_i says how surely the bucket tells the classes apart in the sample (its log-odds over their standard error), by itself or
together with any other one, so that the many words that tell nothing stay near 0 and those that tell only in pairs don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Buckets of hashed features; bucket 0 is the one that every document has.
BUCKETS = 1 << 18
#: The sample that the model is fitted on has so many rows at most: the labelled ones with the smallest hashes.
MOST_ROWS = 16_000
RANK = 8
#: Passes over the sample, and steps of a batch each, at least.
EPOCHS = 8
STEPS = 400
FOLDS = 5
#: Groups that all buckets are dealt into when pairs are screened, how often, and standard errors that a group's best partner has by chance.
GROUPS = 1024
ROUNDS = 6
SURE = 4.5


def held_out(doc_id: Column) -> Column:
    """Whether the document is of the fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


@dataclass
class Model:
    bias: float
    scale: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A score from 0 to 1 for each document; its buckets are ids[starts[k]:starts[k+1]], one at least."""
        out = []
        for lo in range(0, len(starts), 4096):  # bounds the gathered factors
            part = starts[lo : lo + 4096]
            end = starts[lo + 4096] if lo + 4096 < len(starts) else len(ids)
            out.append(self._logits(ids[part[0] : end], part - part[0])[0])
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def _logits(self, ids, starts):
        x = self.scale[ids]
        vx = self.factors[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * ((sums * sums).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        return self.bias + np.add.reduceat(self.linear[ids] * x, starts) + pairs, x, vx, sums


def certainty(ids: np.ndarray, starts: np.ndarray, labels: np.ndarray, buckets: int) -> np.ndarray:
    """By bucket, from 0 to 1: how far the log-odds of the classes stand from those of all words, in standard errors."""
    rows = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
    yes = np.bincount(ids, weights=labels[rows], minlength=buckets)
    no = np.bincount(ids, minlength=buckets) - yes
    p, q = max(labels.sum(), 1), max((1 - labels).sum(), 1)
    a = 0.5 * p / (p + q)
    odds = np.log((yes + a) / (p - yes + 1)) - np.log((no + 0.5 - a) / (q - no + 1))
    z = np.maximum(np.abs(odds) / np.sqrt(1 / (yes + a) + 1 / (no + 0.5 - a)) - 1, 0)  # what tells nothing stands one off by chance
    x = np.where(yes + no > 1, z * z / (z * z + 9), 0)
    x[0] = 1
    return x.astype(np.float32)


def paired(ids: np.ndarray, starts: np.ndarray, labels: np.ndarray, buckets: int, groups: int = GROUPS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """By bucket, from 0 to 1: how surely it tells the classes apart together with some other bucket, whichever of all that is.

    Each round deals all buckets into groups with random signs. Two buckets that tell only together vary together in another
    way in one class than in the other, and so do the signed sums of their groups. A bucket counts by the best partner of its
    group, in the last but one of the rounds, so that those that only share a group with such a bucket don't. A round costs
    the sample's size and rows * groups**2, whatever the number of buckets, and no pair of buckets is left out.
    """
    n = len(starts)
    size = np.diff(np.append(starts, len(ids)))
    often = np.bincount(ids, minlength=buckets)
    often[0] = 0  # the bucket that all have
    seen = np.flatnonzero(often >= 8)
    out = np.zeros(buckets, np.float32)
    if len(seen) < 2 or min(labels.sum(), n - labels.sum()) < 8:
        return out
    trust = 1 / (1 + size / size.mean())  # sums over long documents are noisy
    rng = np.random.default_rng(seed)
    held = np.zeros((rounds, len(seen)))
    for k in range(rounds):
        group = rng.integers(0, groups, buckets)
        sign = np.where(rng.random(buckets) < 0.5, -1.0, 1.0) * (often > 0)
        spread = np.zeros((2, groups, groups))
        for label in (0, 1):
            docs = np.flatnonzero(labels == label)
            total, moment = np.zeros(groups), np.zeros((groups, groups))
            for lo in range(0, len(docs), 2048):  # bounds the dense sums
                part = docs[lo : lo + 2048]
                seg = np.repeat(np.arange(len(part)), size[part])
                own = ids[np.repeat(starts[part] - np.cumsum(size[part]) + size[part], size[part]) + np.arange(size[part].sum())]
                sums = np.bincount(seg * groups + group[own], weights=sign[own], minlength=len(part) * groups).reshape(-1, groups).astype(np.float32)
                weighed = sums * trust[part, None].astype(np.float32)
                total += weighed.sum(0, dtype=np.float64)
                moment += sums.T @ weighed
            whole = trust[docs].sum()
            spread[label] = moment / whole - np.outer(total, total) / whole**2
        own = np.sqrt(np.maximum(np.diagonal(spread, axis1=1, axis2=2).mean(0), 1e-9))
        apart = np.abs(spread[1] - spread[0]) / np.outer(own, own)
        np.fill_diagonal(apart, 0)
        usual = np.median(apart[apart > 0]) / 0.6745 if (apart > 0).any() else 1.0
        held[k] = (apart.max(1) / max(usual, 1 / np.sqrt(n)))[group[seen]]
    z = np.maximum(np.sort(held, axis=0)[min(1, rounds - 1)] - SURE, 0)
    out[seen] = z * z / (z * z + 9)
    return out


def fit(ids: np.ndarray, starts: np.ndarray, labels: np.ndarray, buckets: int = BUCKETS, rank: int = RANK, epochs: int = EPOCHS, steps: int = STEPS, rate: float = 0.1, penalty: float = 1e-5, seed: int = 3, batch: int = 256) -> Model:
    """AdaGrad on the logistic loss, where each class weighs by the root of its rarity. Without rows, the model gives 0.5 to all; with one class, near its label."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(buckets, np.float32), np.zeros(buckets, np.float32), (rng.standard_normal((buckets, rank)) * 0.02).astype(np.float32))
    if not len(starts):
        model.factors[:] = 0
        return model
    labels = labels.astype(np.float64)
    weigh = np.sqrt(0.5 * (len(labels) + 2) / np.where(labels > 0, labels.sum() + 1, len(labels) - labels.sum() + 1))
    model.scale = np.maximum(certainty(ids, starts, labels, buckets), paired(ids, starts, labels, buckets))
    share = ((weigh * labels).sum() + 1) / (weigh.sum() + 2)
    model.bias = float(np.log(share / (1 - share)))
    used = model.scale[ids] > 0.05
    rows = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))[used]
    ids = ids[used]
    starts = np.searchsorted(rows, np.arange(len(starts)))
    model.factors[model.scale <= 0.05] = 0
    model.scale[model.scale <= 0.05] = 0
    ends = np.append(starts[1:], len(ids))
    seen_w, seen_v = np.full(buckets, 1e-3, np.float32), np.full((buckets, rank), 1e-3, np.float32)
    for _ in range(max(epochs, -(-steps // -(-len(starts) // batch)))):
        order = rng.permutation(len(starts))
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            size = ends[docs] - starts[docs]
            first = np.cumsum(size) - size
            at = np.repeat(starts[docs] - first, size) + np.arange(size.sum())
            seg = np.repeat(np.arange(len(docs)), size)
            own = ids[at]
            z, x, vx, sums = model._logits(own, first)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[docs]
            g *= weigh[docs]
            gx = (g[seg] * x).astype(np.float32)
            keys, back = np.unique(own, return_inverse=True)
            grad_w = np.bincount(back, weights=gx, minlength=len(keys)) / batch + penalty * model.linear[keys]
            each = gx[:, None] * (sums[seg] - vx)
            grad_v = np.stack([np.bincount(back, weights=each[:, f], minlength=len(keys)) for f in range(rank)], 1) / batch + penalty * model.factors[keys]
            seen_w[keys] += grad_w**2
            model.linear[keys] -= rate * grad_w / np.sqrt(seen_w[keys])
            seen_v[keys] += grad_v**2
            model.factors[keys] -= 0.3 * rate * grad_v / np.sqrt(seen_v[keys])
    return model


#: Turns an Arrow batch into the buckets of each row: ids in one array, and where each row's begin.
Features = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def train(docs: DataFrame, labels: DataFrame, features: Features, most_rows: int = MOST_ROWS) -> Model:
    """Fit on labels (doc_id, label 0 or 1) of documents outside the held-out fold.

    At most most_rows labelled rows are used: those whose hash is smallest. Null labels and ids are left out; of several
    labels of a document the largest counts, of several rows of a document the one with the smallest hash of its text. Only these
    rows' buckets come to the driver, so many a row as there are buckets at most.
    """
    known = labels.where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = known.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(most_rows).select(F.col("doc_id").alias("_id"), "label")
    rows = docs.join(F.broadcast(known), docs["doc_id"] == known["_id"])  # most_rows rows of 12 bytes
    rows = rows.drop("_id")
    first = F.struct(F.xxhash64("text"), F.xxhash64(*rows.columns))
    rows = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*rows.columns), first).alias("_row")).select("_row.*")  # each task hands on one row a document

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = features(batch)
            parts = np.split(ids.astype("<i4"), starts[1:]) if len(starts) else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "label", "ids"])

    got = rows.mapInArrow(gather, "doc_id long, label int, ids binary").toArrow().sort_by("doc_id")  # in an order of its own
    parts = [np.frombuffer(x, "<i4") for x in got.column("ids").to_pylist()]
    size = np.array([len(p) for p in parts], np.int64)
    return fit(np.concatenate(parts) if parts else np.zeros(0, np.int32), np.cumsum(size) - size, got.column("label").to_numpy())


def scored(docs: DataFrame, model: Model, features: Features, name: str = "score") -> DataFrame:
    """docs with a score for each row; one pass over the texts, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # fixed by BUCKETS and RANK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = features(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(ids, starts), pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def predictions(docs: DataFrame, model: Model, features: Features, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    rows = scored(docs, model, features)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
