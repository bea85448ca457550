"""Clustering and codes against plain Lloyd rounds, and their handling of odd rows."""

import hashlib

import duckdb
import numpy as np
import pytest

from tidemark.llm import catalog, dual_tree, heap_codes
from tidemark.llm.vector_blocks import squared

SCHEMA = "vec_id long, embedding array<float>, label int, DISTANCE string, cluster string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)


def _clustered(n, dim=64, seed=0, groups=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + rng.normal(scale=rng.choice([0.01, 0.1, 0.5], n)[:, None], size=(n, dim))
    x[n // 3 : n // 2] = x[0]  # copies
    return np.round(x, 3).astype(np.float32)


def _floors(x):
    return np.floor(256 * x.astype(np.float64)).astype(np.int64)


def _lloyd(x, c, rounds):
    c = c.copy()
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        if r < rounds:
            for k in set(near.tolist()):
                c[k] = x[near == k].sum(axis=0) // (near == k).sum()
    return near, d.min(axis=1), c


@pytest.mark.parametrize("n, block", [(900, 1 << 18), (900, 64 * 50)])
def test_clusters_equal_plain_lloyd(spark, n, block):
    v = _clustered(n)
    x = _floors(v)
    order = sorted(range(n), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    near, away, c = _lloyd(x, x[order[:40]], 5)
    out, centroids = dual_tree.cluster(_vectors(spark, [(i, v[i].tolist(), 0) for i in range(n)]).repartition(3), most=block)
    found = {r.vec_id: r for r in out.collect()}
    assert centroids.tolist() == c.tolist()
    assert [found[i].cluster for i in range(n)] == near.tolist()
    assert [found[i].distance for i in range(n)] == away.tolist()
    assert {r.inertia for r in found.values()} == {int(away.sum())}
    assert all(r.cluster_inertia == away[near == r.cluster].sum() for r in found.values())


def test_cover_tree_holds_its_bounds_and_prunes():
    x = _floors(_clustered(2000, seed=3)).astype(np.int64)
    tree, order = dual_tree.cover_tree(x)
    assert sorted(order.tolist()) == list(range(2000))
    x = x[order]
    for i in range(len(tree.lo)):
        away = np.sqrt(((x[tree.lo[i] : tree.hi[i]] - x[tree.lo[i]]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[i] + 1e-6
        kids = range(tree.first[i], tree.last[i])
        if kids:
            assert tree.lo[kids[0]] == tree.lo[i] and tree.hi[kids[-1]] == tree.loose[i]
            centres = x[tree.lo[kids]]
            apart = np.sqrt(squared(centres.astype(float), centres.astype(float)))
            assert (apart[~np.eye(len(kids), dtype=bool)] > tree.radius[i] / 2 - 1e-3).all()
    pieces = list(dual_tree.assign(x, tree, dual_tree.Centroids(x[::50])))
    whole = sum(hi - lo for lo, hi, _, away in pieces if away is None)
    assert whole > 500, "whole nodes go to one centroid without a look at their vectors"
    assert sum(hi - lo for lo, hi, _, _ in pieces) == 2000


def test_clusters_of_odd_rows(spark):
    one, half = [1.0] * 64, [0.5] * 64
    rows = [(1, one, 0), (1, one, 0), (2, half, 0), (3, None, 0), (4, [*one[:63], None], 0), (5, [*one[:63], float("nan")], 0), (6, [*one[:63], float("inf")], 0), (7, [1.0] * 63, 0), (8, [], 0), (None, half, 0), (9, [3e30] * 64, 0)]
    out, centroids = dual_tree.cluster(_vectors(spark, rows))
    assert sorted((r.vec_id or 0, r.distance) for r in out.collect()) == [(0, 0), (1, 0), (1, 0), (2, 0), (9, 0)]
    assert len(centroids) == 4, "fewer rows with a vec_id make fewer centroids; equal ones stay both"
    twins = {r.cluster for r in out.where("vec_id = 1").collect()}
    assert len(twins) == 1, "a tie of equal centroids goes to the smaller number"
    empty, none = dual_tree.cluster(_vectors(spark, []))
    assert empty.count() == 0 and len(none) == 0


@pytest.mark.parametrize("n, block", [(700, 1 << 18), (700, 64 * 40)])
def test_codes_equal_plain_lloyd(spark, n, block):
    v = _clustered(n, seed=5)
    x = _floors(v)
    coded, books, popped = heap_codes.compress(_vectors(spark, [(i, v[i].tolist(), None if i % 3 else 1) for i in range(n)]).repartition(3), rounds=4, most=block)
    found = {r.vec_id: r for r in coded.collect()}
    error = np.zeros(n, np.int64)
    for p in range(16):
        own = x[:, 4 * p : 4 * p + 4]
        near, away, c = _lloyd(own, own[:64], 4)
        assert books[p].tolist() == c.tolist()
        assert [found[i].codes[p] for i in range(n)] == near.tolist()
        error += away
    assert [found[i].error for i in range(n)] == error.tolist()
    assert popped[0] == 16 * n and popped[-1] < popped[0], "later rounds scan only what drift has reached"


def test_heaps_give_all_that_drift_has_reached():
    rng = np.random.default_rng(1)
    codes, keys, drift = rng.integers(0, 9, 500), rng.random(500), rng.random(12)
    heap, starts = heap_codes.heaped(codes, keys, 12)
    for a, b in zip(starts, starts[1:], strict=False):
        assert all(keys[heap[a + (i - 1) // 2]] <= keys[heap[a + i]] for i in range(1, b - a))
    assert sorted(heap_codes.violated(heap, starts, keys, drift).tolist()) == np.flatnonzero(keys <= drift[codes]).tolist()


def test_codes_of_odd_rows(spark):
    one = [0.25] * 32
    rows = [(2, one, 5), (1, [0.5] * 32, None), (1, [0.5] * 32, None), (None, one, 5), (3, None, 5), (4, [0.1] * 31, 5), (5, [float("nan")] * 32, 5), (6, [], None)]
    out = {(r.vec_id, r.code): r for r in heap_codes.reported(_vectors(spark, rows)).collect()}
    assert {k for k, _ in out} == {None, 1, 2, 4, 6}
    assert out[(4, None)].error is None and out[(4, None)].label_error == 0
    assert out[(1, "00" * 16)].error == 0 and out[(2, "02" * 16)].label_error == 0
    assert heap_codes.reported(_vectors(spark, [])).count() == 0
    without = heap_codes.compress(_vectors(spark, rows).drop("label"))[0]
    assert without.where("label is null").count() == 6


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_vector_codes"])
def test_queries_equal_sql(spark, name, sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    sql = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(catalog.queries()[name](spark, sf_dir).select(columns).collect()) == sorted(sql.fetchall())
