"""The operators in SQL functions: line dedup, licences, mixing, rules and components."""

import random
import re
import textwrap

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, licenses, line_dedup, mixing, rules
from tidemark.llm.components import components


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 8)))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_keeps_the_first_of_similar_lines(spark):
    rng = random.Random(3)
    long = [word(rng) for _ in range(40)]
    near = list(long)
    near[20] = "changed"
    line, other, third = " ".join(long), " ".join(near), " ".join(word(rng) for _ in range(40))
    docs = [(1, f"{line}\n\nown line here\n{third}", 9), (2, f"Another start of it\n{other}", 9), (3, f"{third.upper()}  \nlast", 9), (4, None, 9), (5, "", 9), (6, "short\nshort\nsHort ", 9)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, line_no int")).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("Another start of it", 1), 3: ("last", 1), 4: (None, 0), 5: ("", 0), 6: ("short", 2)}
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_licenses_in_usual_files(spark):
    mit, bsd, apache = licenses.TEXTS["MIT"], licenses.TEXTS["BSD-3-Clause"], licenses.TEXTS["Apache-2.0"]
    commented = lambda t, mark: "\n".join((mark + " " + line).rstrip() for line in t.split("\n"))
    wrapped = lambda t: "\n".join(textwrap.fill(p, 70) for p in t.split("\n"))
    named = bsd.replace("the copyright holder nor", "Example, Inc. nor").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "JANE Q. DOE").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "JANE Q. DOE OR HER HEIRS")
    bullets = re.sub(r"(?m)^[0-9]\. ", "* ", wrapped(named))
    docs = {
        1: ("MIT License\n\nCopyright (c) 2020 A\n\n" + mit).replace("\n", "\r\n"),
        2: ("Some words.\n\n" + bsd + "\n\nMore.").replace("\n", "\r\n"),
        3: commented("MIT License\n\nCopyright (c) 2020 A\n\n" + wrapped(mit), "#"),
        4: commented(wrapped(apache), "//") + "\nint main() {}\n",
        5: "#!/bin/sh\n" + commented(wrapped(apache), "#") + "\nimport os\n# a note\n",
        6: "/*\n" + commented(wrapped(mit), " *") + "\n */\nint x;",
        7: named,
        8: bullets,
        9: mit.replace("\n", "\r"),
        10: "Neither a licence nor the name of it: 1. permission 2. redistribution",
    }
    got = {r.doc_id: (r.whole_license, r.licenses) for r in licenses.scan(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "BSD-3-Clause"), 3: ("MIT", "MIT"), 4: (None, "Apache-2.0"), 5: (None, "Apache-2.0"), 6: (None, "MIT"), 7: ("BSD-3-Clause",) * 2, 8: ("BSD-3-Clause",) * 2, 9: ("MIT", "MIT"), 10: (None, "")}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(docs.items()))
    assert {r[0]: (r[2], r[3]) for r in con.execute(catalog.oracle_sql()["op9_license_scan"]).fetchall()} == got


def test_licenses_that_are_known_besides(spark):
    own = "The Example Licence\n\nYou may use this for all that is good.\n\nAnd permission ends with the day."
    more = spark.createDataFrame([("Example-1.0", own)], "license string, text string")
    docs = spark.createDataFrame([(1, own.upper().replace("\n", "\r\n")), (2, "x"), (None, None)], "doc_id long, text string")
    assert {r.doc_id: r.whole_license for r in licenses.scan(docs, more).collect()} == {1: "Example-1.0", 2: None, None: None}


def test_licenses(spark):
    mit = "Copyright (c) 2001 Someone\n\n" + licenses.TEXTS["MIT"].lower().replace(",", " ,")
    titled = "MIT License\n\nCopyright (c) 2020 A\n\n" + licenses.TEXTS["MIT"]
    inside = "A header.\n\n" + licenses.TEXTS["BSD-3-Clause"].replace(" ", "  ") + "\n\nMore text.\n\n" + licenses.TEXTS["MPL-2.0"]
    spaced = [(10, titled, "MIT", "MIT"), (11, inside, None, "BSD-3-Clause,MPL-2.0"), (12, "Released  under CC0 1.0.", "CC0-1.0", "CC0-1.0"), (13, "Released\nunder CC0 1.0.", "CC0-1.0", "CC0-1.0"), (14, "Distributed\tunder MPL-2.0", "MPL-2.0", "MPL-2.0"), (15, "\n\n \n", None, "")]
    docs = [*((i, t) for i, t, _, _ in spaced), (1, mit), (2, "Words.\nReleased under the MIT Licence.\nMore."), (3, "Licensed under CC BY-NC 4.0. Then more words."), (4, None), (5, "no licence here"), (6, "Licensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: (r.whole_license, r.licenses) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {**{i: (w, x) for i, _, w, x in spaced}, 1: ("MIT", "MIT"), 2: (None, "MIT"), 3: (None, "CC-BY-NC-4.0"), 4: (None, ""), 5: (None, ""), 6: ("Apache-2.0", "Apache-2.0")}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def water_level(sizes, weights, share, most):
    """Targets by resharing the excess until none is above."""
    total, capped = share * sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        open_weight = sum(w for i, w in enumerate(weights) if i not in capped)
        target = [most * s if i in capped else rest * weights[i] / open_weight for i, s in enumerate(sizes)]
        more = {i for i, t in enumerate(target) if t > most * sizes[i] * (1 + 1e-12)} - capped
        if not more:
            return target
        capped |= more


def test_mixing(spark):
    rng = random.Random(6)
    sources = ["a", "B", None, "ö", "z", "only empty"]
    rows = [(i, rng.choices(sources[:5], [9, 1, 3, 2, 1])[0], " ".join(["w"] * rng.randint(0, 40))) for i in range(2000)] + [(9000, "only empty", ""), (9001, "only empty", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, source string, text string, target double").repartition(3)
    got = mixing.mix(df, chunk=16).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7), chunk=16).collect()), key=str)
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    order = sorted({r[1] for r in rows if r[1] is not None}) + [None]
    size = {s: sum(len((r[2] or "").split()) for r in rows if r[1] == s) for s in order}
    target = dict(zip(order, water_level([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2.0), strict=True))
    for s in order:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == size[s]
        assert own[0].target == pytest.approx(target[s])
        assert abs(sum(r.taken for r in own) - target[s]) <= 41
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")).first().taken == 0


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_rules(spark):
    rng = random.Random(9)
    clean = [" ".join(word(rng) for _ in range(rng.randint(80, 200))) for _ in range(300)]
    odd = ["", None, "few words only", "a b c d e " * 30, "same line\n" * 5 + clean[0], "\t \n\x0b", "é漢 " * 20, " ".join(f"{word(rng)}|#*" for _ in range(120)), "one two three four five six one two three four five six seven eight nine ten eleven twelve"]
    rows = [(i, "en", "s", t, 0) for i, t in enumerate(clean + odd)] + [(900, None, None, clean[1] + " more", 0)]
    got = {r.doc_id: r for r in rules.apply_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, n_words int")).collect()}
    for i, _, _, text, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics(text or "")
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert sum(got[i].kept for i in range(300)) >= 298
    assert not got[300 + 7].kept  # symbols in every word
    assert rules.apply_rules(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).count() == 0


def test_determinants_against_concentration_in_numpy(spark):
    """No start of exact concentration steps over rows ends with a much smaller determinant, and centres agree."""
    rng = np.random.default_rng(4)
    clean = rng.multivariate_normal([2, 1.5, 0.4, 0.5, 0.6], np.diag([0.2, 0.05, 0.05, 0.04, 0.03]) + 0.01, 700)
    far = rng.normal([4, 3, 2, 2, 2], 0.05, (150, 5))
    x = np.concatenate([clean, far])
    rows = spark.createDataFrame([(0, "", "", *map(float, r)) for r in x], ["level", "g_lang", "g_source", *rules.AXES])
    got = rules._estimate(rows, rules.CORE, rules.STEPS).first()
    floor, h = np.diag(np.square(rules.FLOOR)), int(np.ceil(rules.CORE * len(x)))
    best = (np.inf, None)
    for _ in range(40):
        core = x[rng.choice(len(x), 30, replace=False)]
        for _ in range(60):
            m, c = core.mean(0), np.cov(core.T, bias=True) + floor
            core = x[np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), kind="stable")[:h]]
        best = min(best, (np.linalg.slogdet(np.cov(core.T, bias=True) + floor)[1], core.mean(0)), key=lambda p: p[0])
    low = np.array([[got[f"l{i}_{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
    mine = np.linalg.slogdet((low @ low.T - floor) / rules.consistency(rules.CORE) + floor)[1]
    assert mine <= best[0] + 0.1 and np.allclose([got[f"m{i}"] for i in range(5)], best[1], atol=0.03)
    sample = rng.normal(size=(400_000, 5))
    core = sample[np.argsort((sample**2).sum(1))[:300_000]]
    assert rules.consistency(0.75) == pytest.approx(1 / core.var(0).mean(), rel=0.01) and rules.consistency(1) == 1


def test_rules_with_more_groups_than_are_broadcast(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, rng.choice(["en", "de"]), rng.choice(["s", "t", None]), " ".join(word(rng) for _ in range(rng.randint(40, 90)))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(3).cache()
    once = {r.doc_id: (r.kept, round(r.distance2, 6)) for r in rules.apply_rules(df).collect()}
    monkeypatch.setattr(rules, "MOST_GROUPS", 0)
    assert once == {r.doc_id: (r.kept, round(r.distance2, 6)) for r in rules.apply_rules(df).collect()}
    df.unpersist()
