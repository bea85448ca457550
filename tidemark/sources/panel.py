"""The daily activity panel: one row per user and day, from raw events or from orders and their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAGS = ("search", "cat", "has_search_to_cart", "has_search_to_ord", "has_cat_to_cart", "has_cat_to_ord")
COUNTS = ("search_to_cart", "search_to_ord", "cat_to_cart", "cat_to_ord", "to_cart", "to_ord", "searches")
MONEY = ("gmv_search", "gmv_cat", "gmv")

PANEL = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("event_date", T.DateType())]
    + [T.StructField(c, T.IntegerType()) for c in FLAGS]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField(c, T.DoubleType()) for c in MONEY]
)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A stored panel, read with its fixed schema so that only asked columns and row groups are scanned."""
    return spark.read.schema(PANEL).parquet(path)


def _panel(rows: DataFrame, key: Column, day: Column, searched: Column, browsed: Column, searches: Column, sums: dict[str, Column]) -> DataFrame:
    out = rows.groupBy(key.cast("long").alias("user_id"), F.to_date(day).alias("event_date")).agg(
        F.max(searched.cast("int")).alias("search"), F.max(browsed.cast("int")).alias("cat"), F.sum(searches.cast("long")).alias("searches"), *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    out = out.withColumns({f"has_{c}": (F.col(c) > 0).cast("int") for c in COUNTS[:4]})
    return out.select(*[F.coalesce(F.col(f.name).cast(f.dataType), F.lit(0).cast(f.dataType)).alias(f.name) if f.name not in ("user_id", "event_date") else F.col(f.name) for f in PANEL])


def events_panel(events: DataFrame) -> DataFrame:
    """Views are searches, sign-ups visits of the catalogue, clicks carts and purchases orders; an even ``k`` in the
    properties tells the search channel from the catalogue. Days with errors alone stay, with zeros."""
    kind = F.col("event_type")
    odd = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)) % 2 == 1
    one = lambda on: on.cast("long")
    value = F.coalesce("value", F.lit(0.0))
    click, bought = kind == "click", kind == "purchase"
    zero = F.lit(0.0)
    sums = {
        "to_cart": one(click), "search_to_cart": one(click & ~odd), "cat_to_cart": one(click & odd),
        "to_ord": one(bought), "search_to_ord": one(bought & ~odd), "cat_to_ord": one(bought & odd),
        "gmv": F.when(bought, value).otherwise(zero), "gmv_search": F.when(bought & ~odd, value).otherwise(zero), "gmv_cat": F.when(bought & odd, value).otherwise(zero),
    }
    return _panel(events, F.col("user_id"), F.col("ts"), kind == "view", kind == "signup", kind == "view", sums)


def orders_panel(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Urgent and high-priority orders come by search, others by the catalogue; lines are carted items, and bought ones
    unless returned. Lines are summed by order before the join, so an order's price counts once."""
    lines = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum((F.col("l_returnflag") != "R").cast("long")).alias("n_kept"))
    rows = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
    by_search = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    carted, kept = F.coalesce("n_lines", F.lit(0)), F.coalesce("n_kept", F.lit(0))
    price, none, zero = F.col("o_totalprice"), F.lit(0).cast("long"), F.lit(0.0)
    sums = {
        "to_cart": carted, "search_to_cart": F.when(by_search, carted).otherwise(none), "cat_to_cart": F.when(~by_search, carted).otherwise(none),
        "to_ord": kept, "search_to_ord": F.when(by_search, kept).otherwise(none), "cat_to_ord": F.when(~by_search, kept).otherwise(none),
        "gmv": price, "gmv_search": F.when(by_search, price).otherwise(zero), "gmv_cat": F.when(~by_search, price).otherwise(zero),
    }
    return _panel(rows, F.col("o_custkey"), F.col("o_orderdate"), by_search, ~by_search, by_search, sums)
