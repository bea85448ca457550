"""Search for parameters by Parzen estimators, with several trials at once and a table of trials that a stopped search goes on from.

Each parameter has two densities, made of kernels at the good and at the other trials and of one as wide as the range. Candidates are
drawn from the density of the good; the one with the best ratio of both is tried next. Trials of a round see those of
earlier rounds, so results do not depend on which of a round ends first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.shared import children, rename


@dataclass(frozen=True)
class Range:
    """Numbers from low to high; drawn evenly, or evenly by logarithm; whole ones if so marked."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, value: float) -> float:
        return float(np.log(value)) if self.log else float(value)

    def outer(self, x: float) -> float:
        value = min(self.high, max(self.low, float(np.exp(x)) if self.log else x))
        return int(round(value)) if self.whole else value


@dataclass(frozen=True)
class Choice:
    values: tuple


@dataclass(frozen=True)
class Trial:
    number: int
    parameters: dict
    value: float


#: Trials drawn at random before densities are used, the share of trials that are good, and candidates for each parameter.
FIRST, GOOD, CANDIDATES = 8, 0.15, 24


def _kernels(points: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths: a kernel is as wide as the way to its farther neighbour, within bounds; one in the middle spans the range."""
    at = np.sort(np.append(points, (low + high) / 2))
    gaps = np.diff(np.concatenate([[low], at, [high]]))
    width = np.clip(np.maximum(gaps[:-1], gaps[1:]), (high - low) / min(100, 1 + len(at)), high - low)
    width[np.searchsorted(at, (low + high) / 2)] = high - low
    return at, width


def _density(x: np.ndarray, kernels: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at, width = kernels
    return (np.exp(-0.5 * ((x[:, None] - at) / width) ** 2) / width).mean(axis=1) + 1e-300


def suggested(trials: list[Trial], space: dict[str, Range | Choice], rng: np.random.Generator, first: int = FIRST, good: float = GOOD, candidates: int = CANDIDATES) -> dict:
    """The parameters to try after these trials; trials without a finite value count as the worst."""
    order = sorted(trials, key=lambda t: (t.value if np.isfinite(t.value) else np.inf, t.number))
    n_good = max(1, int(np.ceil(good * len(order))))
    out = {}
    for name, part in space.items():
        if isinstance(part, Choice):
            near, far = ([1.0 + sum(t.parameters[name] == v for t in some) for v in part.values] for some in (order[:n_good], order[n_good:]))
            near, far = np.array(near) / sum(near), np.array(far) / sum(far)
            if len(trials) < first:
                drawn = rng.integers(0, len(near), 1)
            else:
                drawn = rng.choice(len(near), max(2, candidates // 8), p=near)
            out[name] = part.values[int(drawn[np.argmax((near / far)[drawn])])]
            continue
        low, high = part.inner(part.low), part.inner(part.high)
        if len(trials) < first or low == high:
            out[name] = part.outer(rng.uniform(low, high))
            continue
        near, far = (_kernels(np.array([part.inner(t.parameters[name]) for t in some]), low, high) for some in (order[:n_good], order[n_good:]))
        k = rng.integers(0, len(near[0]), candidates)
        x = rng.normal(near[0][k], near[1][k])
        x = np.where((x < low) | (x > high), rng.uniform(low, high, candidates), x)
        out[name] = part.outer(x[int(np.argmax(_density(x, near) / _density(x, far)))])
    return out


class Trials:
    """Ended trials in a folder; each is there whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _names(self) -> list[str]:
        return [n for n in children(self.spark, self.path) if n.startswith("trial-")]

    def table(self) -> DataFrame:
        """number, parameters (JSON), value."""
        names = self._names()
        schema = "number int, parameters string, value double"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def all(self) -> list[Trial]:
        return [Trial(r.number, json.loads(r.parameters), r.value) for r in self.table().orderBy("number").collect()]

    def commit(self, trial: Trial) -> None:
        unnamed = f"{self.path}/new-{uuid.uuid4().hex}"
        row = (trial.number, json.dumps(trial.parameters, sort_keys=True), float(trial.value))
        self.spark.createDataFrame([row], "number int, parameters string, value double").coalesce(1).write.parquet(unnamed)
        rename(self.spark, unnamed, f"{self.path}/trial-{trial.number:06d}")


def search(objective: Callable[[dict], float], space: dict[str, Range | Choice], trials: int, store: Trials, seed: int = 0, at_once: int = 4, **how) -> list[Trial]:
    """All trials up to so many, in order; the best is that of the least value.

    at_once trials run at a time, each in a pool of its own, which the fair scheduler serves in turn. A parameter set depends
    on the seed, its number and the trials of earlier rounds alone. Trials that the store has are not run again.
    """
    spark = store.spark
    done = {t.number: t for t in store.all()}

    def run(number: int, parameters: dict) -> Trial:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{number % at_once}")
        trial = Trial(number, parameters, float(objective(parameters)))
        store.commit(trial)
        return trial

    for lo in range(0, trials, at_once):
        before = [done[i] for i in range(lo)]
        open_numbers = [i for i in range(lo, min(lo + at_once, trials)) if i not in done]
        asked = {i: suggested(before, space, np.random.default_rng([seed, i]), **how) for i in open_numbers}
        with ThreadPoolExecutor(at_once) as pool:
            jobs = [pool.submit(inheritable_thread_target(spark)(run), i, p) for i, p in asked.items()]
        done |= {t.number: t for t in (j.result() for j in jobs)}
    return [done[i] for i in range(trials)]


def best(trials: list[Trial]) -> Trial:
    return min(trials, key=lambda t: (t.value if np.isfinite(t.value) else np.inf, t.number))
