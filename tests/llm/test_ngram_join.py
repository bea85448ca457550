"""The n-gram join against brute force, through all its paths."""

import random
import re
from collections import defaultdict

import numpy as np

from tidemark.llm import ngram_join as J


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)])


def brute(rows, percent=75):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv")
    text = lambda n: [word() for _ in range(n)]
    rows, passage = [], text(40)
    for base in (text(30), text(60), text(120)):
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    for _ in range(40):
        rows.append(" ".join(text(rng.randint(5, 40)) + passage))
    rows += ["one two three", "One  two\tthree", "one two", "", None, "   \n", "x", "a b c d e", "A b c d E", " ".join(text(3000))]
    rows += [rows[0]] * 5
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    expected = brute(rows)
    for small, frequent in ((48, 12), (3, 10**9), (2, 12)):
        got, links = J.join(df, small=small, frequent=frequent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == expected
        assert links.columns == ["a", "b"]


def test_empty(spark):
    got, _ = J.join(spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0


def test_prefix_tree():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(30):
        base = np.unique(rng.integers(0, 2**63, rng.integers(2, 300)).astype(np.uint64))
        sets.append(base)
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 2**63, 3).astype(np.uint64)])) for _ in range(4)]
    tree = J.PrefixTree(sets)
    for q in sets[::7]:
        near = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))}
        assert set(tree.similar(q, block=8)) == near


def test_overlap_bounds():
    for n in range(1, 60):
        for m in range(1, 60):
            need = J.overlap_needed(n, m)
            assert all((100 * o >= 75 * (n + m - o)) == (o >= need) for o in range(min(n, m) + 1))


def test_packed_tokens():
    x = np.array([5 << 20, (1 << 63) + (7 << 30)], np.uint64)
    assert (J.unpacked(J.packed(x)) == (x >> np.uint64(16) << np.uint64(16))).all()


def test_classes_without_any_doc_id(spark):
    rng = random.Random(21)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    near = [*base[:39], "other"]
    rows = [(None, " ".join(base)), (1, " ".join(near)), (None, " ".join(near)), (None, None), (2, " ".join(near)), (None, "few words")]
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(None, 36, None), (1, 36, 1), (None, 36, None), (None, 0, None), (2, 36, 1), (None, 1, None)], key=str)
    assert list(J.PrefixTree([]).similar(np.array([1], np.uint64))) == []


def test_few_texts_but_the_wanted_ones_are_shuffled(spark):
    docs = spark.range(20_000).selectExpr("id * 7919 - 5 AS doc_id", "'x' AS text").unionAll(spark.createDataFrame([(None, "x"), (-5, "y")], "doc_id long, text string"))
    ids = spark.range(0, 20_000, 50).selectExpr("id * 7919 - 5 AS doc_id")
    left = J.sieved(docs, ids)
    assert left.join(ids, "doc_id").count() == 401 and left.count() <= 420
    assert J.sieved(docs, ids, bits=8).join(ids, "doc_id").count() == 401  # a full map lets all through
    assert J.sieved(docs, ids.limit(0)).count() == 0


def test_the_join_shuffles_texts_of_wanted_documents_alone(spark):
    """Without broadcasts by size, as with many documents."""
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(30))
    rows = [(i, text()) for i in range(400)] + [(400, "a b c d e f g"), (401, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(400,), (7,)], "doc_id long")
    last = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = J._sets_of(docs, ids, last, 5)
        assert plan.count() == 2
        assert "LeftSemi" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
