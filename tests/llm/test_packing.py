"""Packing: ids as the tokenizers library gives them, every piece placed once, sequences gapless and few."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import packing

public = pytest.importorskip("public_tokenizers")


def texts():
    rng = random.Random(5)
    some = ["", None, "a", "Don't stop 12,345 times!\n\n  Ünïcödé ß 漢字 🙂\t end", "<|endoftext|> inside", "x" * 3000]
    return some + [" ".join(rng.choice(["tion", "the", "ouer", "12", "é"]) for _ in range(rng.randint(1, 900))) for _ in range(60)] + ["word " * 9000]


def rows(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "doc_id long, text string, piece string")


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    packed = packing.packed_digests(rows(spark)).collect()
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
    for i, text in enumerate(texts()):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids)
        assert all(r.length == packing.CAPACITY for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(places) <= -(-sum(r.length for r in packed) // packing.CAPACITY) + 1


def test_real_ids_ride_along(spark):
    packed = packing.pack_documents(rows(spark)).collect()
    assert all(len(r.ids) == 4 * r.length for r in packed)


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed_digests(none).count() == 0
    same = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, None)], "doc_id long, text string")
    assert packing.packed_digests(same).count() == 3


def test_best_two_fit_replaces_the_smallest():
    # 6 + 3 leaves a gap of 1; in place of 3, two pieces of 2 fill all
    patterns = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(patterns[0][0]) == [2, 2, 6]
    assert sum(times for _, times in patterns) == 2


def test_best_two_fit_uses_all_pieces_once():
    rng = random.Random(1)
    counts = {length: rng.randint(1, 50) for length in rng.sample(range(1, 101), 40)}
    used = defaultdict(int)
    for lengths, times in packing.best_two_fit(counts, 100):
        assert sum(lengths) <= 100
        for n in lengths:
            used[n] += times
    assert dict(used) == counts
