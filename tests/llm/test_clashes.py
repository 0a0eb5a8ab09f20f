"""Columns of the input that have the names of results, in another case too."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm")
from quillspark.llm import packing, secrets  # noqa: E402


@pytest.mark.parametrize("name", ["secrets", "Secrets"])
def test_redact_keeps_a_column_of_its_own_name(spark, name):
    df = spark.createDataFrame([(1, "password = 'abcdefgh12'", "mine"), (2, None, None)], f"doc_id long, text string, {name} string")
    out = secrets.redact(df)
    assert out.columns == ["doc_id", "text", name]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(1, "[SECRET]'", "mine"), (2, None, None)]


def test_pack_replaces_columns_of_its_results(spark):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(300).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"), F.lit(9).alias("Sequence_ID"), F.lit("x").alias("offset"))
    out = packing.pack(df)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted({r.offset for r in out.collect()}) == [0, 300, 600] and out.select("sequence_id").distinct().count() == 7
