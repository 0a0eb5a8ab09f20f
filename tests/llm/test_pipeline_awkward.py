"""The pipeline over awkward and empty tables."""

from __future__ import annotations

import pytest

pytest.importorskip("quillspark.llm")
pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("awkward")
    words = " ".join(f"w{i * 7919 % 5000}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "token = 'abcdefgh12' is here"), (None, "nothing here"), (None, None), (6, words), (7, words), (8, words + " end")]
    df = spark.createDataFrame([(i, t, "en" if i != 4 else None, None, len(t or "")) for i, t in rows], SCHEMA)
    df.write.parquet(f"{top}/documents.parquet")
    df.limit(0).write.parquet(f"{top}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        table.write.parquet(f"{top}/{name}.parquet")
        table.write.parquet(f"{top}/none/{name}.parquet")
    return str(top)


def test_each_stage_keeps_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect())
    assert [(none, i) for none, i, _ in left] == [(False, i) for i in (1, 2, 3, 4, 4, 5, 6)] + [(True, 0)] * 2  # 7 and 8 are copies of 6
    assert "abcdefgh12" not in " ".join(text for *_, text in left)


def test_run(spark, folder):
    got = pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, None} and all(r.length <= 1024 for r in got)
    assert pipeline.run(spark, f"{folder}/none").collect() == []
