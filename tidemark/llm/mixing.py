"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions alone.

A source's documents share one expected number of copies, target / size of the source. Its whole part is taken outright;
the fractions are rounded by the pivotal method: two documents meet, and words move from one to the other at random, so
that each keeps its expectation and their sum of words stays, until one of them is decided. Documents meet in chunks of
bounded size, each chunk leaves at most one undecided document, and these meet on the next level of a reduction tree. So a
source misses its target by less than the size of one document.

The hot source is spread over as many chunks as it needs; no task gets a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, settle, unit

#: Weights by the source's place, again and again.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: A document is taken so often at most.
MOST = 2.0
#: Undecided documents that meet in one chunk, on average.
CHUNK = 96
SEED = 17

ITEM = "struct<doc_id: bigint, size: bigint, source_size: bigint, target: double, whole: double, part: double>"
STATE = f"struct<out: array<struct<item: {ITEM}, more: double>>, held: {ITEM}>"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, documents, target for rows of (source, size).

    Sources weigh by their place in code-point order, null last. Targets are the water level at which
    sum(min(most * size, level * weight)) is ``share`` of all words: what a source can't take is reshared by weight. There
    is one row per source, so these windows see as many rows as there are sources.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("*", weight.cast("double").alias("weight"), (F.col("source_size") * F.lit(most)).alias("limit"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - full) / open_weight
    per = per.withColumn("level", level)
    reached = F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.col("level"))
    ratio = F.col("limit") / F.col("weight")
    per = per.withColumn("level", F.min_by(reached, F.when(reached.isNotNull(), ratio)).over(everything))
    return per.select("source", "source_size", "documents", F.least("limit", F.coalesce("level", F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _meet(state: Column, item: Column, seed: int) -> Column:
    """The held document meets the next: words move until one of the two is decided."""
    held, out = state["held"], state["out"]
    a, b, s, t = held["part"], item["part"], held["size"].cast("double"), item["size"].cast("double")
    words = a * s + b * t
    most, least = F.least(F.lit(1.0), words / s), F.greatest(F.lit(0.0), (words - t) / s)
    up = unit(held["doc_id"], item["doc_id"], F.lit(seed)) * (most - least) < a - least
    # Written from what the held one gets, so that the decided side is exactly 0 or 1.
    first = F.when(up, most).otherwise(least)
    second = F.when(up, F.greatest(F.lit(0.0), (words - s) / t)).otherwise(F.least(F.lit(1.0), words / t))
    done = lambda x, more: F.array(F.struct(x.alias("item"), more.alias("more")))
    first_done, second_done = (first == 0) | (first == 1), (second == 0) | (second == 1)
    nothing = F.lit(None).cast(ITEM)
    return (
        F.when(held.isNull(), F.struct(out.alias("out"), item.alias("held")))
        .when(first_done & second_done, F.struct(F.concat(out, done(held, first), done(item, second)).alias("out"), nothing.alias("held")))
        .when(first_done, F.struct(F.concat(out, done(held, first)).alias("out"), item.withField("part", second).alias("held")))
        .otherwise(F.struct(F.concat(out, done(item, second)).alias("out"), held.withField("part", first).alias("held")))
    )


def pivotal(items: DataFrame, most_in_source: int, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """Rows (source, item of ITEM) as (source, item, more): more is 0 or 1, with mean item.part.

    most_in_source: the chunks of the largest source on the first level. One document of a source at most is rounded alone.
    """
    start = F.lit(None).cast(STATE)
    start = F.struct(F.array().cast(f"array<struct<item: {ITEM}, more: double>>").alias("out"), F.lit(None).cast(ITEM).alias("held"))
    level, results = 0, []
    rest = items.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("source")) / chunk))) if "chunks" not in items.columns else items
    while True:
        spread = rest.withColumn("chunk", F.pmod(F.xxhash64(F.col("item.doc_id"), F.lit(seed + level)), F.col("chunks")))
        met = spread.groupBy("source", "chunks", "chunk").agg(F.array_sort(F.collect_list("item")).alias("items"))
        folded = met.select("source", "chunks", F.aggregate("items", start, lambda s, x: _meet(s, x, seed)).alias("state"))
        folded = settle(folded, f"level{level}")
        results.append(folded.select("source", F.explode("state.out").alias("o")).select("source", "o.item", "o.more"))
        rest = folded.where("state.held is not null").select("source", F.col("state.held").alias("item"), F.ceil(F.col("chunks") / chunk).cast("long").alias("chunks"))
        level += 1
        if most_in_source <= 1:  # each source met in one chunk, which leaves one at most
            break
        most_in_source = -(-most_in_source // chunk)
    alone = (unit(F.col("item.doc_id"), F.lit(seed), F.lit("last")) < F.col("item.part")).cast("double")
    results.append(rest.select("source", "item", alone.alias("more")))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of (doc_id, source, text).

    size counts words (runs of characters other than ASCII white space); null text has none. Documents without words have
    copies 0. Null is a source like the others. A document's copies depend on the ids, sizes and the seed alone, not on
    partitions, so reruns agree. Rows that repeat a doc_id are rounded each by itself. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = settle(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")
    targets = settle(source_targets(sized, weights, share, most), "targets")
    largest = targets.agg(F.max("documents")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    one = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    one = one.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + F.lit(1e-12)).cast("double"))
    one = one.withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    undecided = (F.col("size") > 0) & (F.col("part") > 1e-12)
    item = F.struct("doc_id", "size", "source_size", "target", "whole", "part").alias("item")
    items = one.where(undecided).select("source", item, F.ceil(F.col("documents") / F.lit(chunk)).cast("long").alias("chunks"))
    rounded = pivotal(items, -(-largest // chunk), seed, chunk).select("source", "item.*", "more")
    sure = one.where(~undecided).select("source", "doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0.0)).alias("whole"), F.lit(0.0).alias("more"))
    both = rounded.drop("part").unionByName(sure)
    copies = (F.col("whole") + F.col("more")).cast("long")
    return both.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
