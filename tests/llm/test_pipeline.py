"""The pipeline: its stages' decisions take effect, and its last rows pack what the stage before kept."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"{k}"))
        rows.append(docs.count())
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    assert rows[1] < rows[0] and rows[2] == rows[1] and rows[3] <= rows[2]
    ends = defaultdict(int)
    for r in docs.collect():
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert max(ends.values()) <= 2048
    assert docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_stages_on_nulls_repeats_and_names_that_clash(spark):
    """The two joins by row key, and line dedup: no name of docs is taken, rows without a doc_id and repeated ones are met."""
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, line, "a", 0, 0, 0, 62), (2, line, "a", 0, 0, 0, 62), (None, "quite another text of some words", None, 0, 0, 0, 32), (None, None, None, 0, 0, 0, None), (3, "", "b", 0, 0, 0, 0), (3, "not the same text under one id", "b", 0, 0, 0, 30), (3, "not the same text under one id", "b", 0, 0, 0, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id long, _copies long, _key long, n_chars int")
    stages = dict(pipeline.STAGES)
    for name in ("line dedup", "n-gram Jaccard join", "mixing sources"):
        got = stages[name](spark, docs, "")
        assert got.columns == docs.columns
        texts = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
        if name == "line dedup":
            assert texts == [(0, ""), (0, rows[2][1]), (1, line), (2, ""), (3, ""), (3, rows[5][1]), (3, rows[5][1])]
        elif name == "n-gram Jaccard join":
            assert len(texts) == 5 and [t for _, t in texts].count(line) == 1 and (3, rows[5][1]) in texts and (0, rows[2][1]) in texts
        else:
            assert set(texts) <= {(i or 0, t or "") for i, t, *_ in rows}
        assert stages[name](spark, docs.limit(0), "").count() == 0


def test_rows_that_differ_by_the_place_of_a_null_stay_apart(spark):
    text = "some text here"
    rows = [(1, None, text, "s"), (1, text, None, "s"), (None, None, text, "s"), (None, text, None, "s"), (1, text, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tags", F.expr("if(lang is null, array(null, 1), array(1, null))"))
    keys = docs.select(pipeline._row_key(docs).alias("a"), pipeline._row_key(docs, 1).alias("b")).distinct().collect()
    assert len(keys) == 4 and len({r.a for r in keys}) == 4 and not {r.a for r in keys} & {r.b for r in keys}
    kept = dict(pipeline.STAGES)["n-gram Jaccard join"](spark, docs, "").collect()
    assert len([r for r in kept if r.text is None]) == 2, "rows without a text are linked with nothing"
    assert len([r for r in kept if r.text == text]) == 1, "of equal texts one stays, with the text"


def test_classifier_stage_on_nulls_and_names_that_clash(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"_SCORE": F.lit(1), "_Features": F.lit("x"), "Label": F.lit(None).cast("int")})
    odd = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    got = dict(pipeline.STAGES)["quality classifier"](spark, docs.unionByName(odd), SF)
    assert got.columns == docs.columns and 0 < got.count() <= docs.count() + 1
    assert labels.count() and dict(pipeline.STAGES)["quality classifier"](spark, docs.limit(0), SF).count() == 0


def test_packing_stage_on_nulls_and_names_that_clash(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (None, "a b", 7), (1, None, 5)], "doc_id long, text string, PIECE int")
    got = dict(pipeline.STAGES)["best-fit packing"](spark, docs, "").collect()
    assert sorted(r.length for r in got)[:3] == [1, 1, 1] and len({(r.sequence_id, r.offset) for r in got}) == 4
    assert dict(pipeline.STAGES)["best-fit packing"](spark, docs.limit(0), "").count() == 0


def test_a_stage_that_the_next_one_has_read_leaves_the_disk(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, "text") for i in range(5)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(pipeline, "STAGES", [(f"stage {k}", lambda spark, docs, sf_dir: docs.withColumn("text", F.concat("text", F.lit("+")))) for k in range(4)])
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    assert sorted(tuple(r) for r in pipeline.run(spark, str(tmp_path)).collect()) == [(i, "text++++") for i in range(5)]
    assert [p.name.split("-")[1] for p in (tmp_path / "shared").iterdir()] == ["stage2"]
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 5
