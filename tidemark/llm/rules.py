"""Quality rules: whole-text statistics, fixed limits, and robust multivariate outliers, in SQL functions alone.

The statistics of a text become a short vector of transformed rates. For each language and source the minimum covariance
determinant is sought by concentration steps: keep the share of rows nearest to the centre, take their mean and covariance,
measure again, until no determinant falls any more. Three starts take them at once: medians and spreads, all rows, and the rows
near the medians on every axis. Of a group's starts the least determinant counts. Its covariance is raised to what the whole of
normal rows would have. Documents far from the centre by Mahalanobis distance are rejected. Every step is one aggregation to a
small table and one join back, for all groups and starts at once, over a table of a few numbers per document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, let, settle

#: Words in the windows that are searched for repeats.
WINDOW = 5
FEWEST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: Share of a group's rows that the estimate rests on.
CORE = 0.75
#: Concentration steps at most, and the relative fall of a determinant that counts as none.
STEPS = 12
STILL = 1e-4
#: Squared distance beyond which a document goes: the 0.9999 quantile of chi squared with five degrees of freedom.
FARTHEST = 25.74
#: Groups with fewer rows take the estimate of their language, and languages with fewer that of all documents.
FEWEST_ROWS = 100
#: Variances are raised by so much, which is what a clean text may differ in a rate that its group does not vary in.
FLOOR = (0.15, 0.05, 0.05, 0.05, 0.05)
#: Slices of distance for each step of its logarithm; the core ends with a slice.
SLICES = 64
GROUP = ["level", "g_lang", "g_source"]
#: Groups (of 22 numbers each) whose estimates are broadcast at most; beyond that each is met by so many salted keys.
MOST_GROUPS = 10_000
SALTS = 32
#: The axes of the vector.
AXES = ("a_words", "a_length", "a_symbols", "a_lines", "a_repeats")


def _covered(hashes: Column) -> Column:
    """Words inside windows (by their hashes, in order) that occur twice or more."""
    tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(t: Column) -> Column:
        again = F.filter(t, lambda e, i: ((i > 0) & (F.get(t, i - 1)["h"] == e["h"])) | (F.get(t, i + 1)["h"] == e["h"]))
        return F.array_sort(F.transform(again, lambda e: e["i"]))

    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get(p, i + 1) - x), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    return let(let(tagged, places), total)


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep's columns with n_words, n_chars, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each whole text.

    Null text counts as empty: all are 0. Lines are split at newlines and count if they hold a word; a line is a
    duplicate if an earlier one of its text equals it. Windows of five words are compared by a 64-bit hash of the words'
    hashes, within one text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*keep, text.alias("_text"))
    words = F.regexp_extract_all("_text", F.lit(WORD), 0)
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.trim(F.translate(x, SPACES, " "))) > 0)
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))

    def repeats(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        same = lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(_covered(v))
        return F.struct(F.size(h).cast("long").alias("n_words"), F.when(F.size(h) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, same)).alias("n_repeat_words"))

    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return base.select(
        *keep,
        F.length("_text").cast("long").alias("n_chars"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(hashed(words), repeats).alias("_w"),
        of_lines.alias("_l"),
    ).select(*keep, "n_chars", "word_chars", "n_symbols", "_w.*", "_l.*")


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The axes: logarithm of words, of characters a word, and of rates of symbols, duplicate lines, repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "a_words": F.log1p("n_words") / 2,
        "a_length": F.log1p(F.col("word_chars") / n),
        "a_symbols": F.log1p(10 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "a_lines": F.log1p(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "a_repeats": F.log1p(F.col("n_repeat_words") / n),
    }


def consistency(core: float) -> float:
    """By what the covariance of the nearest share of normal rows in five dimensions falls short of that of all: core / F7(x), with x the core quantile of chi squared with five degrees of freedom and F7 the distribution with seven."""
    tail = lambda x: math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    five = lambda x: math.erf(math.sqrt(x / 2)) - tail(x) * (1 + x / 3)
    low, high = 0.0, 100.0
    for _ in range(80):
        low, high = ((low + high) / 2, high) if five((low + high) / 2) < core else (low, (low + high) / 2)
    return core / (five(low) - tail(low) * low * low / 15) if core < 1 else 1.0


def _factor(moments: DataFrame, group: list[str], factor: float = 1.0) -> DataFrame:
    """group, centre and the inverse of the covariance's lower Cholesky factor, from sums over the core rows."""
    d = range(len(AXES))
    n = F.col("n")
    out = moments.select(*group, *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in d], *[(F.lit(factor) * (F.col(f"s{i}_{j}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n) + (FLOOR[i] ** 2 if i == j else 0)).alias(f"c{i}_{j}") for i in d for j in d if j <= i])
    for j in d:  # column by column; each step names what the ones before have made
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(F.col(f"c{j}_{j}") - sum((F.col(f"l{j}_{k}") ** 2 for k in range(j)), F.lit(0.0)), F.lit(1e-9))))
        out = out.withColumns({f"l{i}_{j}": (F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}_{j}") for i in d if i > j} or {"_": F.lit(0)})
    return out.select(*group, *[f"m{i}" for i in d], *[f"l{i}_{j}" for i in d for j in d if j <= i])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the joined factor."""
    solved: list[Column] = []
    for i in range(len(AXES)):
        solved.append((F.col(AXES[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}_{k}") * z for k, z in enumerate(solved)), F.lit(0.0))) / F.col(f"l{i}_{i}"))
    return sum((z * z for z in solved), F.lit(0.0))


def _levels(rows: DataFrame) -> DataFrame:
    """Each row of (lang, source, AXES) three times: in its source's group, in its language's, and in that of all."""
    names = [("lang", "source"), ("lang", None), (None, None)]
    groups = [F.struct(F.lit(k).alias("level"), (F.col(x) if x else F.lit("")).alias("g_lang"), (F.col(y) if y else F.lit("")).alias("g_source")) for k, (x, y) in enumerate(names)]
    return rows.select(F.explode(F.array(*groups)).alias("g"), *AXES).select("g.*", *AXES)


def _met(rows: DataFrame, factor: DataFrame) -> DataFrame:
    """rows with each factor of their group, whose rows are counted: few are broadcast, more are joined by salted keys."""
    if factor.count() <= MOST_GROUPS:
        return rows.join(F.broadcast(factor), GROUP)
    salted = factor.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(salted, [*GROUP, "salt"]).drop("salt")


def _moments() -> dict[str, Column]:
    d = range(len(AXES))
    return {f"s{i}": F.col(AXES[i]) for i in d} | {f"s{i}_{j}": F.col(AXES[i]) * F.col(AXES[j]) for i in d for j in d if j <= i}


def _starts(rows: DataFrame) -> DataFrame:
    """GROUP, start and a first factor for each group with enough rows and each of three starts."""
    d = range(len(AXES))
    middle = rows.groupBy(*GROUP).agg(F.count("*").alias("n"), *[F.percentile_approx(a, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, a in enumerate(AXES)]).where(F.col("n") >= FEWEST_ROWS)
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in d]
    medians = middle.select(*GROUP, *[F.col(f"q{i}")[1].alias(f"m{i}") for i in d], *[(spread[i] if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i in d for j in d if j <= i])
    medians = settle(medians, "medians")
    boxed = F.greatest(*[F.abs(F.col(a) - F.col(f"m{i}")) / F.col(f"l{i}_{i}") for i, a in enumerate(AXES)]) <= 1.5
    summed = _met(rows, medians).groupBy(*GROUP).agg(*[F.count(F.when(w, 1)).alias(f"{k}n") for k, w in (("a", F.lit(True)), ("b", boxed))], *[F.sum(F.when(w, x)).alias(f"{k}{c}") for k, w in (("a", F.lit(True)), ("b", boxed)) for c, x in _moments().items()])
    summed = settle(summed, "summed")
    out = medians.withColumn("start", F.lit(0))
    for k, start in (("a", 1), ("b", 2)):
        own = summed.select(*GROUP, *[F.col(f"{k}{c}").alias(c) for c in ["n", *_moments()]]).where("n > 0")
        out = out.unionByName(_factor(own, GROUP).withColumn("start", F.lit(start)))
    return out


def _estimate(rows: DataFrame, core: float, steps: int) -> DataFrame:
    """The factor of each group (of GROUP) with enough rows. rows: GROUP and AXES.

    A concentration step is one aggregation: rows are summed by slices of their distance, and the nearest slices that
    hold the core are added up. So a group of any size is a few hundred rows before it's shuffled.
    """
    keys = [*GROUP, "start"]
    factor = _starts(rows)
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    logdet = sum((F.log(f"l{i}_{i}") for i in range(len(AXES))), F.lit(0.0))
    last = None
    for _ in range(steps):
        factor = settle(factor, "factor")
        sliced = _met(rows, factor).withColumn("slice", F.floor(SLICES * F.log1p(_distance())))
        sliced = sliced.groupBy(*keys, "slice").agg(F.count("*").alias("n"), *[F.sum(x).alias(k) for k, x in _moments().items()])
        inner = sliced.withColumns({"_before": before, "_all": F.sum("n").over(whole)}).where(F.col("_before") < core * F.col("_all"))
        sums = settle(inner.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in ["n", *_moments()]]), "sums")
        factor = _factor(sums, keys)
        total = factor.agg(F.sum(logdet)).first()[0]
        if total is None or last is not None and abs(total - last) <= STILL:
            break
        last = total
    else:
        if not steps:
            return factor.where("start = 0").drop("start")
    best = factor.groupBy(*GROUP).agg(F.min(F.struct(logdet.alias("d"), "start"))["start"].alias("start"))
    return settle(_factor(sums.join(best, keys), GROUP, consistency(core)), "factor")


def apply_rules(docs: DataFrame, core: float = CORE, steps: int = STEPS, farthest: float = FARTHEST) -> DataFrame:
    """Statistics, base_failed, distance2 and kept for each row of (doc_id, lang, source, text).

    A document that fails the base rules is rejected and takes no part in the estimates. Null languages and sources are
    groups of their own. Where no group of a document has enough rows, distance2 is null and the base rules decide.
    """
    stats = settle(text_statistics(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"), "text")).withColumns(vector()).withColumn("base_failed", base_failed()), "statistics")
    factor = _estimate(_levels(stats.where("not base_failed")), core, steps)
    names = [f"m{i}" for i in range(len(AXES))] + [f"l{i}_{j}" for i in range(len(AXES)) for j in range(i + 1)]
    out = stats.withColumn("_none", F.lit(""))
    few = factor.count() <= MOST_GROUPS
    for level, (lang, source) in enumerate((("lang", "source"), ("lang", "_none"), ("_none", "_none"))):
        own = factor.where(F.col("level") == level).select(F.col("g_lang").alias(f"lang@{level}"), F.col("g_source").alias(f"source@{level}"), *[F.col(n).alias(f"{n}@{level}") for n in names])
        out = out.join(F.broadcast(own) if few else own, (F.col(lang) == F.col(f"`lang@{level}`")) & (F.col(source) == F.col(f"`source@{level}`")), "left")
    out = out.withColumns({n: F.coalesce(*[F.col(f"`{n}@{level}`") for level in range(3)]) for n in names}).withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= farthest, F.lit(True))
    return out.select("doc_id", "n_words", "n_chars", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "distance2", "base_failed", kept.alias("kept"))
