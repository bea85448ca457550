"""Tables and versions in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a single machine takes a folder of its own, and a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written to the shared folder (in a folder for each value of by) and read again, so that a lost executor costs only the tasks it ran."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, system = _hadoop(spark, path)
    system.delete(at, True)


def drop(*settled: DataFrame) -> None:
    """Deletes settled tables that nothing will read any more."""
    for df in settled:
        for folder in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    at, system = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder in one step; False if the target is there already."""
    (a, system), (b, _) = _hadoop(spark, source), _hadoop(spark, target)
    return not system.exists(b) and system.rename(a, b)
