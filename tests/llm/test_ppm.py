"""Language-model scores against a plain model of dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import catalog, ppm

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def symbols(text):
    return [256] * ppm.ORDER + list((text or "").translate(FOLD).encode()) + [256]


def brute(rows, order=ppm.ORDER):
    """Scores by doc_id; each probability is taken from the definition, with the excluded symbols as a set."""
    after, words = defaultdict(Counter), Counter()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)) + [None]
    for i, t in rows:
        if not held(i):
            words.update(split(t))
            s = symbols(t)
            for at in range(order, len(s)):
                for k in range(order + 1):
                    after[tuple(s[at - k : at])][s[at]] += 1
    n, v = sum(words.values()), len(words)

    def log_p(context, symbol):
        out, excluded = 0.0, set()
        for k in range(order, -1, -1):
            counts = after.get(tuple(context[len(context) - k :]), {})
            left = {x: c for x, c in counts.items() if x not in excluded}
            if not left:
                continue
            total = sum(left.values())
            if symbol in left:
                return out + math.log10((left[symbol] - 0.5) / total)
            out += math.log10(0.5 * len(left) / total)
            excluded |= set(counts)
        return out - math.log10(257 - len(excluded))

    found = {}
    for i, t in rows:
        s, own = symbols(t), split(t)
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        found[i] = (held(i), len(own), sum(words[w] > 0 for w in own), n, base, sum(log_p(s[at - order : at], s[at]) for at in range(order, len(s))))
    return found


def check(found, expected):
    assert {r.doc_id for r in found} == set(expected)
    for r in found:
        got, want = tuple(r)[1:], expected[r.doc_id]
        assert got[:4] == want[:4]
        assert got[4:] == pytest.approx(want[4:], abs=1e-5, rel=1e-9)


ODD = [(0, "The cat sat on the mat. The CAT\tsat."), (1, None), (2, ""), (3, "the hat sat"), (4, "Zyx 汉字 ẞ \x00\u0085 end"), (5, "aaaaaaaaaaaaaaaaaaaaaaaaaa" * 40), (6, " \n\t "), (7, "the cat sat on the mat. the cat sat."), (None, "no id at all")]
ODD += [(i, f"the {w} sat on the {w} of {i % 4}") for i, w in enumerate(["cat", "dog", "hat", "mat"] * 10, 10)]


@pytest.mark.parametrize("block", [ppm.BLOCK, 200, 1])
def test_against_plain_model(spark, block):
    assert any(held(i) for i, _ in ODD[10:]), "some are held out"
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id int, text string, GRAM string, word int").repartition(3)
    check(ppm.lm_scores(docs, most=block).collect(), brute(ODD))


def test_grams_of_many_texts_are_those_of_each():
    texts = [b"", b"a", ("abc déf " * 90 + "x" * 500).encode(), b"", b"tail"]
    one = [ppm.grams([t]).tolist() for t in texts]
    assert ppm.grams(texts).tolist() == [x for t in one for x in t]
    s = symbols(texts[2].decode())
    assert one[2] == [sum(v << 9 * (ppm.ORDER - k) for k, v in enumerate(s[at - ppm.ORDER : at + 1])) for at in range(ppm.ORDER, len(s))]
    for most in (1, 3, 10**6):
        runs = list(ppm.windows(texts, most))
        assert [t for _, run in runs for t in run] == texts and [lo for lo, _ in runs] == sorted({lo for lo, _ in runs})


def test_a_long_text_stays_whole(spark):
    rows = [(1, "many words and more " * 200_000), (2, "x" * 3_000_000), (3, "many words")]
    out = {r.doc_id: r for r in ppm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_tokens, out[2].n_tokens, out[3].n_tokens) == (800_001, 2, 3)
    assert out[2].score / 3_000_001 > -0.01


def test_repeated_ids_and_nothing_to_learn(spark):
    rows = [(7, "same text"), (7, "same text"), (7, "other")]
    out = ppm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 3 and len({(r.base_score, r.score) for r in out}) == 2
    only_held = next(i for i in range(100) if held(i))
    (r,) = ppm.lm_scores(spark.createDataFrame([(only_held, "ab")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (2, 0, 0)
    assert r.score == pytest.approx(-3 * math.log10(257)) and r.base_score == pytest.approx(0.0)
    assert ppm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_plain_model(spark, sf_dir="/root/testdata/sf0.001"):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute(rows)
    found = catalog.queries()["op13_lm_scores"](spark, sf_dir).collect()
    check(found, expected)
    texts = dict(rows)
    unseen = [r for r in found if r.held_out and texts[r.doc_id] and texts[r.doc_id] not in {t for i, t in rows if not held(i)}]
    assert sum(r.score for r in unseen) < 0


def test_counts_of_a_block(monkeypatch):
    """Words and grams of a block against plain counters, with grams merged many times and with a window of many texts."""
    rng = np.random.default_rng(6)
    texts = [bytes(rng.choice(list(b"ab \n\tc"), rng.integers(0, 40))) for _ in range(300)] + [b"", b" lead", b"trail\x0b", "汉字\x85 \x1c x".encode()]
    out = rng.random(len(texts)) < 0.3
    words, grams = Counter(), Counter()
    for t, h in zip(texts, out, strict=True):
        words.update({w: 0 for w in [b"", *t.split()]} if h else Counter([b"", *t.split()]))
        grams.update({g: 0 for g in ppm.grams([t]).tolist()} if h else Counter(ppm.grams([t]).tolist()))
    distinct, n, at, sizes = ppm._words([memoryview(t) for t in texts], out)
    assert dict(zip(distinct.to_pylist(), n.tolist(), strict=True)) == dict(words) and distinct[-1].as_py() == b""
    assert [distinct[int(i)].as_py() for i in at] == [w for t in texts for w in t.split()]
    assert sizes.tolist() == [len(t.split()) for t in texts]
    for window, merged_above in ((100, 5), (ppm.WINDOW, ppm.WINDOW)):
        monkeypatch.setattr(ppm, "WINDOW", merged_above)
        monkeypatch.setattr(ppm.windows, "__defaults__", (window,))
        g, n = ppm._counted([memoryview(t) for t in texts], out, ppm.ORDER)
        assert dict(zip(g.tolist(), n.tolist(), strict=True)) == dict(grams) and (np.diff(g) > 0).all()


def test_a_block_takes_little_memory_beyond_its_texts(monkeypatch):
    """Words and grams are counted by windows, in few numbers for each; counts beyond what stands beside a gram in one number are whole."""
    rng = np.random.default_rng(8)
    texts = [memoryview(b" ".join(bytes(rng.choice(list(b"abc"), 3)) for _ in range(60)) + b"zz" * 900) for _ in range(400)]
    out = np.arange(len(texts)) % 7 == 0
    peaks = []
    for window in (1 << 30, 1 << 15):
        monkeypatch.setattr(ppm, "WORDS_WINDOW", window)
        most = []
        split = ppm._words
        monkeypatch.setattr(ppm, "_words", lambda run, held, split=split, most=most: most.append(sum(map(len, run))) or split(run, held))
        words, n, _ = ppm._word_counts(texts, out)
        monkeypatch.setattr(ppm, "_words", split)
        peaks.append(max(most))
        counts = Counter(w for t, h in zip(texts, out, strict=True) for w in [b"", *bytes(t).split()] if not h)
        assert {w: k for w, k in zip(words.to_pylist(), n.tolist(), strict=True) if k} == counts
    assert peaks[1] <= 1 << 15 < peaks[0]
    packed = ppm._packed_counts(texts, out, ppm.ORDER)
    grams = Counter(g for t, h in zip(texts, out, strict=True) for g in ppm.grams([t]).tolist() if not h)
    assert packed.dtype == np.int64 and (np.diff(packed >> ppm.BITS) >= 0).all() and max(grams.values()) > 100 * ppm.MOST
    assert len(packed) <= len(set(packed >> ppm.BITS)) + sum(grams.values()) // ppm.MOST
    g, n = ppm._unpacked(packed)
    assert {a: b for a, b in zip(g.tolist(), n.tolist(), strict=True) if b} == grams
