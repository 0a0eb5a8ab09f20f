"""Fuzzy joins of rows that must share another column too, and edits of bytes."""

from __future__ import annotations

from quillspark.operators import fuzzy as fz
from quillspark.plans import catalogue


def test_equal_columns(spark):
    a = spark.createDataFrame([(1, "abcd", 1), (2, "abcd", 2), (3, "xxxx", 1), (4, "abcd", None)], "i long, a string, g long")
    b = spark.createDataFrame([(7, "abce", 1), (8, "abc", 2), (9, "abcd", None), (10, "abcd", 3)], "j long, b string, h long")
    got = fz.joined(a, "a", b, "b", distance=1, equal={"g": "h"})
    assert sorted((r.i, r.j, r.distance) for r in got.collect()) == [(1, 7, 1), (2, 8, 1)]
    assert sorted(got.columns) == ["a", "b", "distance", "g", "h", "i", "j"]


def test_no_product_of_the_nations(spark):
    """Suppliers and customers meet by near numbers, not all with all of their nation."""
    plan = catalogue.queries()["JN16"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    at = next(x for x in plan.splitlines() if "Join" in x)
    assert "nationkey" in at and "_b" in at
