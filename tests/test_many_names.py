"""Documents with names of a dictionary of any size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import dictionary as dc


@pytest.mark.parametrize("part", [dc.PART, 3])
@pytest.mark.parametrize("repeated", [False, True])
def test_name_counts(spark, part, repeated):
    rows = [(1, "a a a b"), (2, "c"), (3, None), (4, "b c d, a a"), (None, "a a")] + [(4, "a a x")] * repeated
    docs = spark.createDataFrame(rows, "id long, text string")
    names = spark.createDataFrame([("a a",), ("a b",), ("b c d",), ("a a",), ("zz",), (None,), ("",)], "name string")
    got = {r.id: (r.n_names, r.n) for r in dc.name_counts(docs, "id", dc.spaced(F.col("text")), names, "name", part).collect()}
    assert got == {1: (2, 3), 4: (2, 3 if repeated else 2), None: (1, 1)}
