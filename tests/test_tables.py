"""Quantiles by selection, files found by name, folds that replace themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.sources import tables


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_quantiles_equal_sorting(spark, bins):
    rng = np.random.default_rng(1)
    parts = {"wide": np.concatenate([rng.normal(size=300) * 1e9, rng.normal(size=300) * 1e-9]), "ties": np.repeat([1.0, 2.0, 5.0], [50, 1, 49]), "one": np.array([3.5]), "far": np.array([-1.7e308, 0.0, 5e-324, 1.7e308])}
    rows = [(n, float(v)) for n, vs in parts.items() for v in vs] + [("wide", None), ("ties", float("nan")), ("other", 1.0), ("endless", float("inf")), ("endless", 0.0)]
    shares = [0.0, 0.005, 0.37, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(rows, "name string, value double").repartition(3)
    got = exact_quantiles(df, {n: shares for n in [*parts, "none", "endless"]}, bins=bins)
    for n in ("wide", "ties", "one"):
        assert got[n] == pytest.approx(np.quantile(parts[n], shares).tolist(), rel=1e-12)
    assert got["far"][0] == -1.7e308 and got["far"][-1] == 1.7e308 and got["far"][3] == 0.0
    assert got["none"] == [None] * 6 and got["endless"][-1] == np.finfo(float).max


def test_files_are_found_at_any_depth_and_named(spark, tmp_path):
    root = tmp_path / "snapshot_b" / "root"  # a name above the root doesn't count
    for k, name in enumerate(["deep/er/snapshot_a", "snapshot_b", "snapshot_b_late", "unnamed"]):
        spark.range(k + 1).write.parquet(f"file://{root}/{name}")
    found = tables.discovered(spark, f"file://{root}", "id long", names=["snapshot_a", "snapshot_b", "snapshot_b_late"])
    got = {r.snapshot_name: (r.n, r.w) for r in tables.weighted(found, {"snapshot_b": 2}).groupBy("snapshot_name").agg(F.count("*").alias("n"), F.max("sample_weight").alias("w")).collect()}
    assert got == {"snapshot_a": (1, 1.0), "snapshot_b": (2, 2.0), "snapshot_b_late": (3, 1.0), None: (4, 1.0)}
    by_folder = tables.discovered(spark, f"file://{root}", "id long")
    assert {r.snapshot_name for r in by_folder.collect()} == {"snapshot_a", "snapshot_b", "snapshot_b_late", "unnamed"}


def test_a_repeated_fold_replaces_itself(spark, tmp_path):
    path = f"file://{tmp_path}/folds"
    fold = lambda k, v, n: spark.range(n).select(F.col("id").alias("user_id"), F.lit(v).alias("prediction"), F.lit(k).alias("fold"))
    for k, v, n in ((1, 0.1, 3), (2, 0.2, 4), (1, 0.3, 2)):
        tables.append_fold(fold(k, v, n), path)
    got = sorted((r.fold, r.user_id, r.prediction) for r in spark.read.parquet(path).collect())
    assert got == [(1, 0, 0.3), (1, 1, 0.3), *[(2, i, 0.2) for i in range(4)]]
