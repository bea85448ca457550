"""What the operators of this subpackage share: tables, the shared folder, small SQL idioms."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Counted rows of a key and a number or two that are broadcast at most; joins with more shuffle.
MOST_BROADCAST = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a single machine takes a folder of its own; a cluster has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own_folder()


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again.

    This cuts the lineage: what stands before is computed once, and a lost executor costs only the tasks it ran.
    """
    path = f"{shared_folder(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has executors delete shuffle files that no query needs any more: Spark does so when the driver collects garbage, by itself every half hour."""
    spark._jvm.System.gc()


def gather(spark: SparkSession, parts: Iterable[DataFrame], schema: str, name: str = "table") -> DataFrame:
    """All rows of the parts, which are made and written to one folder one after the other."""
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)  # the folder is there without parts
    for df in parts:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(*settled: DataFrame) -> None:
    """Deletes settled tables that nothing will read any more."""
    for df in settled:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, a settled table of a key and a number or two, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


def fresh(names: Iterable[str], name: str) -> str:
    """name, or one like it that isn't among names, which columns are matched by in either case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit(*key: Column | str) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
