"""Degrees at the end of their range, and numbers as text."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.plans import catalogue


def test_points_at_the_range_of_longitudes(spark, tmp_path):
    """Key 98,400 lies at -80 degrees; computed in doubles, 98400 * 0.7 % 160 is just below 160."""
    spark.createDataFrame([(14,  "N14"), (15, "N15")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    keys = [k for k in range(0, 2_000_000, 1600) if round(k * 0.7 % 160 - 80, 1) == 80.0]
    assert keys
    spark.createDataFrame([(keys[0], 14.0 * 250)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert {r.place: r.n for r in catalogue.queries()["AN12_map"](spark, str(tmp_path)).collect()} == {"N15": 1}


def test_fixed_at_its_edges(spark):
    values = [-0.0, 0.0, -0.04, 0.05, 0.25, 45.15, -12.345, math.inf, -math.inf, math.nan, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(tx.fixed(F.col("x"), 1)).collect()]
    assert got == [None if v is None else "%.1f" % v for v in values]
