"""Parameter search: repeatable, better than chance, and resumed where it stopped."""

import numpy as np
import pytest

from tidemark.operators import search as S

SPACE = {"x": S.Range(-5, 5), "y": S.Range(1e-4, 1.0, log=True), "n": S.Range(1, 30, whole=True), "kind": S.Choice(("a", "b", "c"))}


def bowl(p):
    return (p["x"] - 1.5) ** 2 + (np.log10(p["y"]) + 2) ** 2 + ((p["n"] - 12) / 10) ** 2 + {"a": 1.0, "b": 0.0, "c": 2.0}[p["kind"]]


def rounds(seed, trials, first):
    done = []
    for i in range(trials):
        p = S.suggested(done, SPACE, np.random.default_rng([seed, i]), first=first)
        done.append(S.Trial(i, p, bowl(p)))
    return S.best(done).value


def test_better_than_chance():
    found, chance = ([rounds(seed, 50, first) for seed in range(12)] for first in (8, 10**9))
    assert np.median(found) < 0.6 * np.median(chance)


def test_same_seed_same_trials_and_a_stopped_search_goes_on(spark, tmp_path):
    whole = S.search(bowl, SPACE, 12, S.Trials(spark, f"file://{tmp_path}/whole"), seed=3, at_once=3, first=4)
    assert all(isinstance(t.parameters["n"], int) and 1 <= t.parameters["n"] <= 30 and -5 <= t.parameters["x"] <= 5 for t in whole)
    store, calls = S.Trials(spark, f"file://{tmp_path}/stopped"), []

    def killed(p):
        calls.append(p)
        if len(calls) == 8:
            raise KeyboardInterrupt
        return bowl(p)

    with pytest.raises(KeyboardInterrupt):
        S.search(killed, SPACE, 12, store, seed=3, at_once=3, first=4)
    had = len(store.all())
    assert 6 <= had < 12
    again = []
    assert S.search(lambda p: again.append(p) or bowl(p), SPACE, 12, store, seed=3, at_once=3, first=4) == whole
    assert len(again) == 12 - had and store.table().count() == 12


def test_failed_trials_count_as_the_worst():
    trials = [S.Trial(i, {"x": float(i % 5), "y": 0.1, "n": 3, "kind": "a"}, float("nan") if i % 2 else 1.0) for i in range(10)]
    assert S.best(trials).number == 0
    assert set(S.suggested(trials, SPACE, np.random.default_rng(0))) == set(SPACE)
