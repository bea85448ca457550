"""Reading and writing feature, prediction and submission tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.stacking import prediction_column

TECHNICAL = ("event_date", "user_id", "day_index", "target")


def read_snapshots(spark: SparkSession, paths: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Several stored snapshots as one; weights by cutoff_date give a sample_weight."""
    df = spark.read.parquet(*paths)
    if weights:
        table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w))])
        df = df.withColumn("sample_weight", F.coalesce(F.try_element_at(table, F.col("cutoff_date").cast("string")), F.lit(1.0)))
    return df


def discovered(spark: SparkSession, root: str, schema: str, pattern: str = "*.parquet", names: list[str] | None = None) -> DataFrame:
    """Rows of all files below root, at any depth, whose own name fits the pattern, with file_path and snapshot_name.

    snapshot_name is the one of names that the path below root holds (the longest, if it holds several), null if none; without names
    it is the folder that the file is in. The files' schema is given, so none is opened to find it out.
    """
    found = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root).select("*", F.col("_metadata.file_path").alias("file_path"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    above = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).depth()
    parts = F.split(F.regexp_replace("file_path", "^[a-z0-9]+:(//[^/]*)?", ""), "/")  # an empty one, then folders and the file
    below = F.array_join(F.slice(parts, above + 2, F.size(parts)), "/")
    if names is None:
        name = F.element_at(F.split("file_path", "/"), -2)
    else:
        name = F.coalesce(*[F.when(F.contains(below, F.lit(n)), F.lit(n)) for n in sorted(names, key=lambda n: (-len(n), n))], F.lit(None).cast("string"))
    return found.withColumn("snapshot_name", name)


def weighted(df: DataFrame, weights: dict[str, float], by: str = "snapshot_name") -> DataFrame:
    """df with sample_weight: that of the row's name, 1 for others."""
    weight = F.coalesce(*[F.when(F.col(by) == k, F.lit(float(w))) for k, w in weights.items()], F.lit(1.0))
    return df.withColumn("sample_weight", weight)


def feature_columns(df: DataFrame, technical: tuple[str, ...] = TECHNICAL) -> list[str]:
    return [c for c in df.columns if c not in technical]


def write_snapshot(df: DataFrame, path: str) -> None:
    """By cutoff, so that a fold's snapshots are pruned at the scan; zstd, rewriting only the cutoffs that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("cutoff_date").parquet(path)


def append_fold(df: DataFrame, path: str) -> None:
    """Predictions of a fold: each fold has a folder of its own, so a rerun replaces it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """user_id and predict (not below 0), whatever the prediction column is called."""
    names = spark.read.option("header", True).csv(path).columns
    df = spark.read.schema(", ".join(f"`{n}` {'long' if n == 'user_id' else 'double'}" for n in names)).option("header", True).csv(path)
    return df.select("user_id", F.greatest(F.lit(0.0), F.col(prediction_column(df))).alias("predict"))


def existing(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """The paths that exist, on whatever file system they are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return {k: p for k, p in paths.items() if (x := hadoop(p)).getFileSystem(conf).exists(x)}


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    """A run's summary as one JSON line."""
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
