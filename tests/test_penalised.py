"""Elastic-net paths against a plain fit and a plain cross-validation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import penalised as pn


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.4)
        weights = np.ones(20)
        weights[:3] += 2 * y
        rows.append((i, " ".join(rng.choice(vocabulary, 12, p=weights / weights.sum())), y))
    rows += [(1_000, None, 1), (1_001, "wa wb", None), (None, "wa", 1)]
    return spark.createDataFrame(rows, "id long, text string, y int")


def plain(x, y, mixing, penalty, steps=20_000):
    w = np.zeros(x.shape[1])
    step = 1 / (0.25 * np.linalg.eigvalsh(x.T @ x / len(x))[-1])
    for _ in range(steps):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(x)
        v = w - step * g
        v[:-1] = np.sign(v[:-1]) * np.maximum(np.abs(v[:-1]) - step * penalty * mixing, 0) / (1 + step * penalty * (1 - mixing))
        if np.abs(v - w).max() < 1e-10:
            break
        w = v
    return w


def area(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2) if len(pos) and len(neg) else None


def test_path_and_folds(spark, docs, monkeypatch):
    monkeypatch.setattr(pn, "STEPS", 80)
    monkeypatch.setattr(pn, "TOLERANCE", 1e-5)
    m = pn.matrix(docs, "id", "text", "y", features=50, folds=2, repeats=1)
    assert m.size == 241 and len(m.terms) == 20
    found = pn.fitted(m, [0.1, 1.0], [0.1, 0.02])
    rows = m.rows.collect()
    x, y, folds = np.zeros((len(rows), 21)), np.array([r.label for r in rows]), np.array([r.folds for r in rows])
    for i, r in enumerate(rows):
        x[i, r.at] = r.n
    x[:, -1] = 1
    assert np.allclose(x[:, :-1].std(0), m.deviation)
    assert np.allclose(x[:, :-1].mean(0), m.mean)
    x[:, :-1] = (x[:, :-1] - m.mean) / m.deviation
    areas = {}
    for (repeat, fold, mixing, penalty), w in found.items():
        train = folds[:, repeat] != fold
        want = plain(x[train], y[train], mixing, penalty)
        assert np.abs(w - want).max() < 5e-3
        if fold >= 0:
            areas.setdefault((mixing, penalty), []).append(area(y[~train], np.round(1 / (1 + np.exp(-x[~train] @ w)), 9)))
    assert len(found) == (2 * 1 + 1) * 2 * 2
    by_fold = pn.areas_by(pn.scored(m, found), ["mixing", "penalty", "repeat", "fold"], "score", "label")
    got = {}
    for r in by_fold.collect():
        got.setdefault((r.mixing, r.penalty), []).append(r.area)
    assert {k: sorted(v) for k, v in got.items()} == {k: pytest.approx(sorted(v)) for k, v in areas.items()}


def test_single_class_and_no_rows(spark, docs):
    one = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double").withColumn("k", F.lit("a"))
    assert [r.area for r in pn.areas_by(one, ["k"], "score", "label").collect()] == [None]
    with pytest.raises(ValueError):
        pn.matrix(docs.where("y is null"), "id", "text", "y")
