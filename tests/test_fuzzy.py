"""Fuzzy joins against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import fuzzy as fz


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def changed(rng, s, n):
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        s = rng.choice([s[:at] + rng.choice("abé") + s[at:], s[:at] + s[at + 1 :], s[:at] + rng.choice("abé") + s[at + 1 :]])
    return s


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(7)
    base = ["".join(rng.choices("abé", k=rng.choice([0, 1, 2, 3, 5, 8, 10, 14, 20, 30]))) for _ in range(60)]
    return sorted({*base[:60], *(changed(rng, s, rng.randrange(5)) for s in base for _ in range(2))}), sorted({*base[:30], *(changed(rng, s, rng.randrange(5)) for s in base for _ in range(2))})


@pytest.mark.parametrize("measure", [{"distance": 0}, {"distance": 1}, {"distance": 2}, {"distance": 4}, {"similarity": 0.9}, {"similarity": 0.75}, {"similarity": 1.0}])
def test_all_pairs(spark, strings, measure):
    left, right = strings
    want = set()
    for a in left:
        for b in right:
            d, n = levenshtein(a, b), max(len(a), len(b))
            if d <= measure["distance"] if "distance" in measure else (1 - d / n if n else 1.0) >= measure["similarity"]:
                want.add((a, b, d))
    frames = (spark.createDataFrame([(x,) for x in [*xs, None, xs[-1]]], "s string") for xs in strings)
    one, two = frames
    got = [tuple(r) for r in fz.close(one, "s", two, "s", **measure).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_rows_and_measures(spark):
    left = spark.createDataFrame([(1, "abies alba"), (2, "abies alba"), (3, None), (4, "x")], "id long, name string")
    right = spark.createDataFrame([("a", "abies albo"), ("b", "abies albo"), ("c", None)], "key string, other string")
    assert sorted((r.id, r.key, r.distance) for r in fz.joined(left, "name", right, "other", similarity=0.9).collect()) == [(1, "a", 1), (1, "b", 1), (2, "a", 1), (2, "b", 1)]
    assert fz.joined(left, "name", right.limit(0), "other", distance=2).collect() == []
    for bad in ({}, {"similarity": 0.9, "distance": 1}, {"similarity": 0.0}):
        with pytest.raises(ValueError):
            fz.close(left, "name", right, "other", **bad)


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "No mycorrhizal funghi were seen, no mycorrhizal fungi at all"), (2, "All plant species and all plants speces"), (3, None), (4, "")], "id long, text string")
    phrases = spark.createDataFrame([("mycorrhizal fungi",), ("All plant species",), (None,), ("",)], "p string")
    got = sorted((r.id, r.phrase, r.found, r.place) for r in fz.phrases_in(docs, "id", "text", phrases, "p", 0.9).collect())
    assert got == [(1, "mycorrhizal fungi", "mycorrhizal funghi", 2), (2, "all plant species", "all plant species", 1)]
    assert fz.phrases_in(docs, "id", "text", phrases.limit(0), "p").collect() == []
