"""Substring deduplication against brute force, and its parts."""

import hashlib
import random

import numpy as np

from tidemark.llm import suffix_dedup as S


def brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, rows = text(160), []
    for _ in range(30):
        rows.append(text(rng.randint(0, 200)) + passage[: rng.randint(60, 160)] + text(rng.randint(0, 200)))
    base = text(900)
    for _ in range(8):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(900)] = "Z"
        rows.append("".join(copy))
    rows += [base, base, "", None, "x", "ab" * 300, "a" * 99, "a" * 100, "a" * 101, passage[:100], text(20000) + base]
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus()
    order = random.Random(1).sample(rows, len(rows))
    df = spark.createDataFrame([(i, t, "s") for i, t in order], "doc_id long, text string, spans string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in S.dedup(df).collect()}
    assert got == brute(rows, S.LENGTH)


def test_empty_and_repeated_rows(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "".join(chr(97 + (i * i) % 26) for i in range(400))
    same = S.dedup(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")).collect()
    assert len({(r.doc_id, r.n_removed) for r in same}) == 2


def test_loser_tree_merges_with_lengths():
    rng = random.Random(2)
    runs = []
    for _ in range(7):
        strings = sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 40)))
        runs.append((strings, [0, *(S.common_length(a, b, 0) for a, b in zip(strings, strings[1:], strict=False))][: len(strings)]))
    out, before = [], b""
    for run, place, shared in S.LoserTree(runs).merged():
        s = runs[run][0][place]
        assert shared == S.common_length(before, s, 0) or not out
        before = s
        out.append(s)
    assert out == sorted(s for strings, _ in runs for s in strings)


def test_united():
    docs, lo, hi = S.united(np.array([1, 1, 2, 1, 2]), np.array([0, 5, 3, 20, 4]), np.array([5, 9, 8, 30, 6]))
    assert list(zip(docs, lo, hi, strict=True)) == [(1, 0, 9), (1, 20, 30), (2, 3, 8)]
