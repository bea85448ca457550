"""The fits of btyd count every summary, however many there are."""

import random

import pytest

from tidemark.operators import btyd


def test_more_summaries_than_the_driver_takes(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        t, x = rng.randint(30, 300), rng.choice([0, 0, 1, 2, 3, 5, 8])
        rows.append((x, rng.randint(1, t) if x else 0, t, float(rng.randint(5, 90))))
    df = spark.createDataFrame(rows, "frequency long, recency int, T int, monetary_value double").repartition(2).cache()
    b, g = btyd.fit_bgnbd(df), btyd.fit_gamma_gamma(df)
    monkeypatch.setattr(btyd, "MOST_SUMMARIES", 20)
    assert btyd.fit_bgnbd(df) == pytest.approx(b, rel=1e-2)
    assert btyd.fit_gamma_gamma(df) == pytest.approx(g, rel=1e-2)
    df.unpersist()
