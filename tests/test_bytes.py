"""Strings compared by bytes, as the SQL engine of the checks compares them."""

from __future__ import annotations

from pyspark.sql import functions as F
from quillspark.operators import extraction as ex
from quillspark.operators import fuzzy as fz


def test_phrases_in(spark):
    docs = spark.createDataFrame([(1, "x oié la que"), (2, "x on la que")], "id long, text string")
    wanted = spark.createDataFrame([("in la que",)], "p string")
    found = lambda **k: sorted(r.id for r in fz.phrases_in(docs, "id", "text", wanted, "p", 0.8, **k).collect())
    assert found() == [1, 2] and found(octets=True) == [2]


def test_statements(spark):
    docs = spark.createDataFrame([(1, "in öf the thing ab"), (2, "in xf the thing of"), (3, "that  the"), (4, "of the thong, of the things")], "id long, text string")
    of = lambda **k: sorted((r.id, r.similarity) for r in ex.statements(docs.withColumn("text", F.concat("text", F.lit(" of"))), "id", "text", {"x": ["of the thing"]}, **k).collect())
    assert of() == [(1, 0.9167), (2, 0.9167), (4, 0.9231)] and of(sql=True) == [(2, 0.9167), (4, 0.9231)]
