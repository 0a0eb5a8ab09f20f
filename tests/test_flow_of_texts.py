"""Texts that differ in case or white space alone are different texts."""

from __future__ import annotations

from quillspark.plans import catalogue


def test_distinct_texts(spark, tmp_path):
    rows = [(1, "A b"), (2, "a  b"), (3, "A b"), (4, ""), (5, ""), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 0), (3, 0), (5, 0), (1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.step: r.n for r in catalogue.queries()["AN18"](spark, str(tmp_path)).collect()}
    assert got == {"identified": 6, "distinct": 3, "labelled": 2, "kept": 1}
