"""Mixing over several levels of the reduction tree."""

import pytest

from tidemark.llm import mixing


def test_sources_of_many_chunks_miss_by_less_than_a_document(spark):
    rows = [(i, f"s{i % 12:02}", "w " * 100) for i in range(4800)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), share=0.7, chunk=8).groupBy("source", "target").sum("taken").collect()
    assert len(got) == 12 and any(r.target % 100 for r in got)
    for r in got:
        assert r["sum(taken)"] == pytest.approx(r.target, abs=100)
