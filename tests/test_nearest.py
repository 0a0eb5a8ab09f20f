"""Nearest names against all comparisons."""

from __future__ import annotations

import random

import pytest

from quillspark.functions.text import jaro_winkler
from quillspark.operators import nearest as nr


def made(rng, n):
    parts = ["".join(rng.choices("abcdefghiklmnoprstuvyz", k=3)) for _ in range(400)]
    return sorted({"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)})


def test_all_comparisons(spark):
    rng = random.Random(4)
    known = ["", "é", "中文", *made(rng, 1_500)]
    asked = ["", "zz", "é", "中", *(n[:-1] + "q" for n in rng.sample(known[3:], 40)), *made(rng, 60)]
    want = {n: min((round(1 - jaro_winkler(n, c), 9), i) for i, c in enumerate(known)) for n in asked}
    rows = spark.createDataFrame([*enumerate(asked), (10_000, None)], "id long, name string").repartition(3)
    candidates = spark.createDataFrame([*enumerate(known), (-1, None)], "at long, c string")
    for part in (nr.PART, 4_000):
        got = {r.id: r for r in nr.nearest(rows, "id", "name", candidates, "c", "at", part).collect()}
        assert len(got) == len(asked) + 1 and got[10_000].distance is None and got[10_000].candidate is None
        for i, n in enumerate(asked):
            assert (got[i].distance, got[i].candidate) == (want[n][0], known[want[n][1]]), n


def test_bounds_and_skipped_share():
    rng = random.Random(5)
    known = nr.Candidates(made(rng, 150_000))
    assert len(known.names) > 100_000
    skipped = []
    for name in [n + "x" for n in rng.sample(known.names, 30)]:
        bounds = known.bounds(name)
        for i in rng.sample(range(len(known.names)), 50):
            assert bounds[i] >= jaro_winkler(name, known.names[i]) - 1e-12
        skipped.append(1 - known.nearest(name)[2] / len(known.names))
    assert sum(skipped) / len(skipped) > 0.99


def test_ties_and_empty_sides(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "zz")], "id long, name string")
    same = spark.createDataFrame([("b", "abx"), ("a", "aby")], "o string, c string")
    got = {r.id: (r.distance, r.candidate) for r in nr.nearest(rows, "id", "name", same, "c", "o").collect()}
    assert got[1] == (pytest.approx(1 - jaro_winkler("ab", "aby")), "aby") and got[2] == (1.0, "aby")
    none = nr.nearest(rows, "id", "name", same.limit(0), "c", "o").collect()
    assert [(r.distance, r.candidate, r.compared) for r in none] == [(None, None, 0)] * 2
    assert nr.nearest(rows.limit(0), "id", "name", same, "c", "o").collect() == []
