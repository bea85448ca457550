"""Finished snapshots that late events reach: versions that hold changed users alone.

A store is a folder of versions. The first has the daily panel and the snapshot of all users, both dealt into buckets by user.
A later one has the late days and the rows of the users that they change; it is written aside and takes its place by one
rename, so readers see it whole or not at all. A late day is added to the user's day (sums are added, flags stay set). Users
whose late days lie after the cutoff change by their target alone, which is a sum, so the days' sum is added to it. Users
with late days before the cutoff may change in maxima, medians, gaps and streaks, which are not sums: these are computed anew
from their own days, and only their buckets are read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import snapshot as N
from tidemark.plans.config import SnapshotConfig
from tidemark.sources.panel import COUNTS, FLAGS, MONEY
from tidemark.sources.shared import children, rename, settle

#: Touched users that are broadcast at most; more are met by a shuffle.
MOST_BROADCAST = 500_000


@dataclass(frozen=True)
class Change:
    """What a version did: users with late days, those whose target alone was added to, those computed anew, and the days read for these."""

    version: int
    touched: int
    added: int
    computed: int
    days_read: int


def merged_days(panel: DataFrame) -> DataFrame:
    """A row for each user and day: counts and money added up, flags set if any is."""
    parts = [F.max(c).cast("int").alias(c) for c in FLAGS] + [F.sum(c).alias(c) for c in (*COUNTS, *MONEY)]
    return panel.groupBy("user_id", "event_date").agg(*parts).select("user_id", "event_date", *FLAGS, *COUNTS, *MONEY)


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, config: SnapshotConfig, buckets: int = 64):
        self.spark, self.path, self.config, self.buckets = spark, path, config, buckets

    def versions(self) -> list[int]:
        return [int(n.removeprefix("version-")) for n in children(self.spark, self.path) if n.startswith("version-")]

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int"))

    def _write(self, df: DataFrame, folder: str) -> None:
        self._bucket(df).repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(folder)

    def _commit(self, days: DataFrame, rows: DataFrame) -> int:
        version = max(self.versions(), default=0) + 1
        aside = f"{self.path}/new-{uuid.uuid4().hex}"
        self._write(days, f"{aside}/days")
        self._write(rows, f"{aside}/rows")
        if not rename(self.spark, aside, f"{self.path}/version-{version:06d}"):
            raise ValueError(f"version {version} is there already: another run writes to {self.path}")
        return version

    def _read(self, part: str, versions: list[int]) -> DataFrame:
        """Rows of a part with bucket and version."""
        found = [self.spark.read.parquet(f"{self.path}/version-{v:06d}/{part}").withColumn("version", F.lit(v)) for v in versions]
        return reduce(DataFrame.unionByName, found)

    def build(self, panel: DataFrame) -> int:
        """The first version, of a whole panel."""
        return self._commit(merged_days(panel), N.snapshot(panel, self.config))

    def panel(self, version: int | None = None) -> DataFrame:
        return merged_days(self._read("days", [v for v in self.versions() if version is None or v <= version]))

    def current(self, version: int | None = None) -> DataFrame:
        """The snapshot as of a version, the last if none is given: of each user the row of the latest version that has one."""
        known = [v for v in self.versions() if version is None or v <= version]
        rows = self._read("rows", known)
        if len(known) == 1:
            return rows.drop("bucket", "version")
        latest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("version")))
        return rows.withColumn("_latest", latest).where("_latest = 1").drop("_latest", "bucket", "version")

    def apply(self, late: DataFrame) -> Change:
        """A new version with late days of the panel's columns. Users that are new to the store get a row too; without late days nothing changes."""
        c = self.config
        late = settle(self._bucket(merged_days(late.where("user_id is not null and event_date is not null"))), "late")
        d = F.datediff(F.lit(c.cutoff).cast("date"), F.col("event_date"))
        users = late.groupBy("user_id", "bucket").agg(F.max((d.between(0, c.recency - 1)).cast("int")).alias("before"), F.coalesce(F.sum(F.when(d.between(-c.horizon, -1), F.col("gmv"))), F.lit(0.0)).alias("more"))
        old = self.current().select("user_id", F.lit(1).alias("known"))
        users = settle(users.join(old, "user_id", "left").withColumn("anew", (F.col("before") == 1) | F.col("known").isNull()), "touched")
        touched, computed = users.agg(F.count("*"), F.coalesce(F.sum(F.col("anew").cast("int")), F.lit(0))).first()
        if not touched:
            return Change(max(self.versions()), 0, 0, 0, 0)
        asked = users.where("anew").select("user_id")
        buckets = [r.bucket for r in users.where("anew").select("bucket").distinct().collect()]  # as many as there are buckets
        days = self._read("days", self.versions()).where(F.col("bucket").isin(buckets)).drop("version").join(F.broadcast(asked) if computed <= MOST_BROADCAST else asked, "user_id", "left_semi")
        own = settle(merged_days(days.unionByName(late.join(asked, "user_id", "left_semi"))), "days")
        anew = N.snapshot(own, c)
        added = self.current().join(users.where("not anew").select("user_id", "more"), "user_id").withColumn("target", F.col("target") + F.col("more")).drop("more")
        rows = anew.unionByName(added.select(anew.columns))
        return Change(self._commit(late.drop("bucket"), rows), touched, touched - computed, computed, own.count())
