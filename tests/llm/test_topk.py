"""Top-k search against brute force."""

import math

import numpy as np

from tidemark.llm import topk


def brute(rows, queries, k):
    sound = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in queries:
        if q in sound:
            scored = sorted((-sum(a * b for a, b in zip(sound[q], v, strict=True)), i) for i, v in sound.items() if i != q and len(v) == len(sound[q]))
            for rank, (s, i) in enumerate(scored[:k], 1):
                out[q, rank] = (i, -s)
    return out


def rows():
    rng = np.random.default_rng(3)
    some = [(i, [float(x) for x in np.round(rng.normal(size=20), 1)]) for i in range(150)]
    some += [(200 + i, list(some[7][1])) for i in range(6)]  # ties
    return some + [(300, None), (301, [float("nan")] * 20), (302, [1.0, None] * 10), (303, [float("inf")] * 20), (304, []), (305, [1.0, 2.0]), (310, [0.5, 0.5])]


def test_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "vec_id long, embedding array<float>")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows()]
    asked = [i for i, _ in rows() if i % 5 == 0]
    for block, most in ((topk.BLOCK, topk.ROUND), (200, topk.ROUND), (60, 200)):  # one round, one of several blocks, several
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, df.where("vec_id % 5 = 0"), block=block, stride=4, most=most).collect()}
        assert got == brute(exact, asked, topk.K)


def test_repeated_rows_and_clashing_names(spark):
    """Each row is a query or a candidate of its own; columns named like the result's are passed over."""
    df = spark.createDataFrame([(5, [1.0], 9), (5, [1.0], 8), (6, [2.0], 7), (6, [2.0], 7), (None, [9.0], 1)], "vec_id long, embedding array<double>, rank int")
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id = 5"), k=2).collect())
    assert got == [(5, 1, 6, 512 * 256), (5, 1, 6, 512 * 256), (5, 2, 6, 512 * 256), (5, 2, 6, 512 * 256)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, df).count() == 0
