"""Connected components of an edge table: alternating large-star and small-star rounds, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is hung on the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    least = both.groupBy("v").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where("u > v").join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are hung on the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    least = down.groupBy("v").agg(F.min("u").alias("m"))
    hung = down.join(least, "v").where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex is either the middle of a star or hangs on one vertex alone."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("v").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (the smallest vertex it reaches) for each vertex of edges (a, b) of one ordered type.

    Loops are passed over and repeated edges count once; an empty table gives an empty one. Rounds go on until the
    edges are stars; their number grows with the logarithm of the widest component. A vertex with very many
    neighbours is summed before the shuffle and joined as a skewed key, never gathered.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        before, now = now, settle(_small_star(_large_star(now)), "edges")
        drop(before)
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
