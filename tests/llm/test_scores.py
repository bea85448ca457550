"""Factorization machines: held-out accuracy, interactions, and defined results for odd rows."""

import os
import zlib

import numpy as np
import pytest

from tidemark.llm import factorization as fm
from tidemark.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def test_pairs_identity():
    rng = np.random.default_rng(0)
    model = fm.Model(0.1, rng.random(50).astype(np.float32), rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    ids = np.array([1, 5, 9, 30, 2, 3])
    x = model.scale[ids[:4]]
    v = model.factors[ids[:4]] * x[:, None]
    z = 0.1 + (model.linear[ids[:4]] * x).sum() + sum(v[i] @ v[j] for i in range(4) for j in range(i))
    assert model.scores(ids, np.array([0, 4]))[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


@pytest.mark.parametrize("tells", [lambda a, b: a & b, lambda a, b: a != b])
def test_learns_an_interaction(tells):
    """Both words together tell the class; with the second rule each of them alone tells nothing at all."""
    rng = np.random.default_rng(1)

    def sample(n):
        a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
        rows = [np.unique([0] + [1] * int(i) + [2] * int(j) + list(3 + k)) for i, j, k in zip(a, b, rng.integers(0, 900, (n, 12)), strict=True)]
        size = np.array([len(r) for r in rows])
        return np.concatenate(rows), np.cumsum(size) - size, tells(a, b).astype(int)

    ids, starts, y = sample(4000)
    model = fm.fit(ids, starts, y, buckets=1024)
    ids, starts, y = sample(2000)
    assert ((model.scores(ids, starts) >= 0.5) == (y == 1)).mean() > 0.97


def _beside_often(rng, n):
    """Two words in half of the texts, beside 600 that are in 60 % of them: more frequent, all of them."""
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
    return [np.concatenate([[0], [1] * int(i), [2] * int(j), 3 + np.flatnonzero(rng.random(600) < 0.6)]).astype(np.int64) for i, j in zip(a, b, strict=True)], a != b


def _beside_many(rng, n):
    """Two words in half of the texts, beside 20,000 of falling frequency, in texts of very different lengths."""
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
    odds = np.cumsum(1 / (np.arange(20_000) + 2.7))
    words = [3 + np.searchsorted(odds / odds[-1], rng.random(int(rng.lognormal(5.7, 0.8)))) for _ in range(n)]
    return [np.concatenate([[0], [1] * int(i), [2] * int(j), np.unique(w)]).astype(np.int64) for i, j, w in zip(a, b, words, strict=True)], a != b


@pytest.mark.parametrize("sample", [_beside_often, _beside_many])
def test_learns_an_interaction_of_any_words(sample):
    """Neither word tells anything alone, and they aren't among the most frequent; words that tell nothing are left out of pairs."""
    rng = np.random.default_rng(4)

    def packed(n):
        rows, y = sample(rng, n)
        size = np.array([len(r) for r in rows])
        return np.concatenate(rows), np.cumsum(size) - size, y.astype(int)

    ids, starts, y = packed(5000)
    found = fm.paired(ids, starts, y, 1 << 15)
    assert found[1] > 0.9 and found[2] > 0.9 and (found[3:] > 0.05).sum() <= 2
    model = fm.fit(ids, starts, y, buckets=1 << 15)
    ids, starts, y = packed(2000)
    assert ((model.scores(ids, starts) >= 0.5) == (y == 1)).mean() > 0.95


def test_pairs_of_a_sample_that_is_too_small():
    for y in ([], [1], [0, 1] * 3, [1] * 40):
        assert not fm.paired(np.tile([0, 1], len(y)), np.arange(len(y)) * 2, np.array(y, int), 64).any()


def test_of_repeated_ids_one_row_is_learned_from(spark):
    """A third of all rows under one id, and nulls: one row an id reaches the driver, whichever way rows are dealt."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 7, if(id = 1, null, id)) doc_id", "concat('word', id % 50, ' text') text", "cast(null as string) _row", "1 _h")
    labels = spark.range(3000).selectExpr("id doc_id", "cast(id % 2 as int) toxic")
    one, two = (fm.train(docs.repartition(k).select("doc_id", "text"), labels.selectExpr("doc_id", "toxic label"), toxicity.terms) for k in (2, 5))
    assert (one.linear == two.linear).all() and (one.factors == two.factors).all()
    assert toxicity.toxicity(docs, labels).count() == 3000


def test_no_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3, "x"), (2, "", None, "x"), (None, "some words", 1, "x"), (2, "", None, "x")], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for got in (toxicity.toxicity(docs, labels).collect(), quality.quality(docs, labels).collect()):
        assert len(got) == 4
        assert all(r.score == pytest.approx(0.5) for r in got)
    one = spark.createDataFrame([(1, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, one).collect())
    assert toxicity.toxicity(docs.limit(0), one).count() == 0
    kept = quality.accepted(docs, one)
    assert kept.columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for run, label in ((quality.quality, "quality"), (toxicity.toxicity, "toxic")):
        got = {r.doc_id: r for r in run(docs, labels).collect()}
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
        truth = [(got[r.doc_id].score, r[label]) for r in labels.collect() if got[r.doc_id].held_out]
        yes, no = [s for s, y in truth if y == 1], [s for s, y in truth if y == 0]
        assert np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no]) >= 0.9  # 0.5 for any constant
