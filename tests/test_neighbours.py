"""Exact neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from quillspark.operators import neighbours as nb


def frame(spark, x, keys=None):
    rows = [(int(k), *map(float, v)) for k, v in zip(keys if keys is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"x{i} double" for i in range(x.shape[1]))), [f"x{i}" for i in range(x.shape[1])]


def brute(x, near):
    out = []
    for i in range(len(x)):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[i] = np.inf
        out.append([(far[j], j) for j in np.lexsort((np.arange(len(x)), far))[:near] if far[j] < np.inf])
    return out


@pytest.mark.parametrize("kind", ["clusters", "grid"])
def test_ten_thousand_rows(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        x = np.concatenate([rng.normal(c, 0.1 + c % 3, (2_000, 3)) for c in (0, 5, 9, 20)] + [np.tile([[1.0, 2.0, 3.0]], (2_000, 1))])
    else:  # many ties
        x = rng.integers(0, 60, (10_000, 2)).astype(float)
    df, names = frame(spark, x)
    got = {r.key: [(n.distance, n.key) for n in r.neighbours] for r in nb.nearest_rows(df, "k", names, 5, block=500).collect()}
    assert len(got) == len(x)
    for i, want in enumerate(brute(x, 5)):
        assert [k for _, k in got[i]] == [k for _, k in want] and np.allclose([d for d, _ in got[i]], [d for d, _ in want])


def test_few_rows_nulls_and_repeats(spark):
    df, names = frame(spark, np.array([[0.0], [1.0], [1.0]]), [5, 7, 7])
    df = df.union(spark.createDataFrame([(9, None), (None, 1.0)], "k long, x0 double"))
    got = sorted((r.key, [(n.distance, n.key) for n in r.neighbours]) for r in nb.nearest_rows(df, "k", names, 5).collect())
    assert got == [(5, [(1.0, 7), (1.0, 7)]), (7, [(0.0, 7), (1.0, 5)]), (7, [(0.0, 7), (1.0, 5)])]
    assert nb.nearest_rows(df.limit(0), "k", names, 5).collect() == []
    assert [r.neighbours for r in nb.nearest_rows(df.where("k = 5"), "k", names, 5).collect()] == [[]]
