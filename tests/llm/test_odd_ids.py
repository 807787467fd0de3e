"""Rows without ids, sums beyond 32 bits, and inputs of many partitions, for the two trained classifiers."""

from __future__ import annotations

import numpy as np
import pytest

from driftloom.llm import language_id, quality_classifier


@pytest.fixture
def folder(spark, tmp_path):
    texts = ["The house stands by the river.", "Das Haus steht am Fluss.", None, ""]
    docs = [(k if k % 7 else None, texts[k % 4], ("en", "de", None, None)[k % 4]) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("query", [language_id.op9_language_id, quality_classifier.op10_quality_classifier])
def test_rows_without_id_are_not_held_out(spark, folder, query):
    rows = query(spark, folder).collect()
    assert len(rows) == 60
    assert all(r.held_out is False for r in rows if r.doc_id is None) and any(r.held_out for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_sums_pass_32_bits():
    signs = quality_classifier.index_signs(quality_classifier.index_places())
    sums = np.full((quality_classifier.BUCKETS, quality_classifier.DIMENSIONS), 2**31 - 1, np.int64)
    quality_classifier.add_contexts(sums, np.array([-1, 5, 6, -1], np.int32), signs)
    assert (sums[5] - signs[6] == 2**31 - 1).all() and (sums[6] - signs[5] == 2**31 - 1).all()


def test_tasks_follow_the_input(spark, monkeypatch):
    """The same vectors however the documents are parted."""
    docs = spark.createDataFrame([(k, f"word{k % 9} and word{k % 4} again") for k in range(200)], "doc_id long, text string")
    monkeypatch.setattr(quality_classifier, "READ", 1)
    a, n = quality_classifier.word_vectors(docs.repartition(70))
    b, m = quality_classifier.word_vectors(docs.coalesce(1))
    assert (a == b).all() and (n == m).all() and n.sum() > 0
