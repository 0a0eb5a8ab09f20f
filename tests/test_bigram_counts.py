"""Counts of bigrams: repeated and missing keys, and what is shuffled."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillspark.operators import extraction as ex


def test_repeated_and_missing_keys(spark):
    rows = [(1, "red fox red fox"), (1, "red fox in"), (2, "red fox"), (3, "blue fox"), (4, None), (4, "lone word"), (None, "grey owl"), (5, "grey owl a1 grey owl"), (6, "blue fox the fox")]
    got = {tuple(r) for r in ex.bigram_counts(spark.createDataFrame(rows, "id long, t string"), "id", "t", ["the", "in"]).collect()}
    assert got == {(1, "red_fox", 3), (2, "red_fox", 1), (3, "blue_fox", 1), (4, None, 0), (None, None, 0), (5, "grey_owl", 2), (6, "blue_fox", 1)}
    most = {tuple(r) for r in ex.bigram_counts(spark.createDataFrame(rows, "id long, t string"), "id", "t", ["the", "in"], 3).collect()}
    assert {r for r in most if r[1]} == {(1, "red_fox", 3), (2, "red_fox", 1), (5, "grey_owl", 2)}


def test_rows_are_shuffled_once_by_bigram(spark):
    docs = spark.range(200).select("id", F.concat(F.lit("red fox w"), (F.col("id") % 7).cast("string")).alias("t"))
    plan = ex.bigram_counts(docs, "id", "t", ["the"])._jdf.queryExecution().executedPlan().toString()
    by = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    assert sum("bigram" in x for x in by) == 1  # a document's own counts need none
