"""Elastic-net paths over repeated folds, all fitted together from one stored feature matrix.

Terms are counted and stored once (``matrix``). A step is one pass over the stored rows for the
models of all repeats, folds and mixings at once: a task multiplies its rows with all coefficients
and adds up the gradients of the rows that each model trains on. Penalties are taken from the largest
down, and each starts from the coefficients of the one before, so that few steps are needed. The
held-out rows of all models are then scored in one pass, and the areas under their ROC curves
come from counts by score, summed up by ranges.

The objective is that of the usual elastic net: mean logistic loss plus ``penalty`` times
(``mixing`` times the absolute coefficients plus half of (1 - ``mixing``) times their squares), on
centred terms divided by their deviation; the intercept is free. What the driver holds are the coefficients
and gradients: terms times models. Steps are accelerated proximal ones with a restart where they
turn back; the step size follows from the largest eigenvalue, which ``ROUNDS`` power steps find.

Defined cases: null texts have no terms; rows without label or key are left out; with a single class
the areas are null; a table without rows raises.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import words
from quillspark.operators.tables import draw, running, shared_folder

ROUNDS, STEPS, TOLERANCE = 12, 40, 1e-4
#: Tasks that add up gradients before the driver does.
ADDERS = 8
#: Rows whose words or terms are Python objects, or a dense block, at a time.
ROWS = 500


@dataclass
class Matrix:
    """Stored rows (key, label, folds, at, n) with the terms' places and counts, and the terms."""

    rows: DataFrame
    terms: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    size: int
    repeats: int
    folds: int


def matrix(docs: DataFrame, key: str, text: str, label: str, features: int = 2_000, least: int = 2, folds: int = 5, repeats: int = 3) -> Matrix:
    """Counts of the ``features`` terms that most documents have (at least ``least``); folds are drawn for
    each repeat by a hash of the key."""
    spark = docs.sparkSession
    known = docs.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    t = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))
    fold = F.array(*[(draw(key, r) % folds).cast("int") for r in range(repeats)])
    rows = known.select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("label"), fold.alias("folds"), t.alias("terms"))
    often = rows.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count().where(F.col("count") >= least)
    terms = [r.term for r in often.orderBy(F.desc("count"), "term").limit(features).collect()]
    place = spark.sparkContext.broadcast({w: i for i, w in enumerate(terms)})

    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    rows.mapInArrow(lambda batches: _counted(batches, place.value), "key string, label int, folds array<int>, at array<int>, n array<float>").write.parquet(path)
    stored = spark.read.parquet(path)
    size = stored.count()
    if not size:
        raise ValueError("no row has a label")
    sums = stored.select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("s"), F.sum(F.col("x.n") * F.col("x.n")).alias("q")).collect()
    mean, deviation = np.zeros(len(terms)), np.ones(len(terms))
    for at, s, q in sums:
        mean[at] = s / size
        deviation[at] = max(np.sqrt(max(q / size - (s / size) ** 2, 0.0)), 1e-12)
    return Matrix(stored, terms, mean, deviation, size, repeats, folds)


def _counted(batches: Iterable[pa.RecordBatch], place: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Rows with the places and counts of their terms, ``ROWS`` at a time."""
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        at, n = [], []
        for found in batch.column(3).to_pylist():
            c = sorted(Counter(place[w] for w in found if w in place).items())
            at.append([i for i, _ in c])
            n.append([float(k) for _, k in c])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["key", "label", "folds", "at", "n"])


def _dense(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows with their centred and scaled terms and a last column of ones."""
    at, n = batch.column(3), batch.column(4)
    x = np.zeros((batch.num_rows, len(scale) + 1))
    lengths = np.diff(at.offsets.to_numpy())
    places = at.flatten().to_numpy()
    x[np.repeat(np.arange(batch.num_rows), lengths), places] = n.flatten().to_numpy()
    x[:, :-1] = (x[:, :-1] - mean) / scale
    x[:, -1] = 1
    return x


def _trains(batch: pa.RecordBatch, models: list[tuple]) -> np.ndarray:
    """For each row and model (repeat, fold, ...) whether it trains on it; a fold of -1 holds nothing out."""
    folds = np.array(batch.column(2).to_pylist()).reshape(batch.num_rows, -1)
    return np.stack([folds[:, r] != f for r, f, *_ in models], axis=1)


def _summed(m: Matrix, width: int, run) -> np.ndarray:
    """The sum over all rows of ``run(batch)``, arrays of (terms + 1) x ``width`` numbers."""
    height = len(m.deviation) + 1

    def each(batches):
        total = np.zeros((height, width))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                total += run(batch.slice(i, ROWS))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def both(batches):
        total = np.zeros(height * width)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), float)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    parts = m.rows.mapInArrow(each, "sum binary").repartition(ADDERS).mapInArrow(both, "sum binary").collect()
    return sum(np.frombuffer(r[0], float) for r in parts).reshape(-1, width)


def fitted(m: Matrix, mixings: Sequence[float], penalties: Sequence[float]) -> dict[tuple[int, int, float, float], np.ndarray]:
    """Coefficients (the intercept last) by (repeat, fold, mixing, penalty); fold -1 trains on all rows."""
    cells = [(r, f) for r in range(m.repeats) for f in range(m.folds)] + [(0, -1)]
    models = [(r, f, a) for (r, f), a in itertools.product(cells, mixings)]
    mean, scale, alpha = m.mean, m.deviation, np.array([a for *_, a in models])
    n = _summed(m, len(models), lambda b: np.ones((len(scale) + 1, 1)) * _trains(b, models).sum(0))[0]
    top = np.ones((len(scale) + 1, 1)) / np.sqrt(len(scale) + 1)
    for _ in range(ROUNDS):

        def power(b, v=top):
            x = _dense(b, mean, scale)
            return x.T @ (x @ v)

        grown = _summed(m, 1, power)
        largest = float(np.linalg.norm(grown))
        top = grown / max(largest, 1e-300)
    step = 1 / (0.25 * 1.2 * largest / np.maximum(n, 1))

    def gradient(w: np.ndarray) -> np.ndarray:
        def run(b):
            x, y = _dense(b, mean, scale), np.asarray(b.column(1).to_numpy(zero_copy_only=False), float)
            error = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y[:, None]
            return x.T @ (error * _trains(b, models))

        return _summed(m, len(models), run) / np.maximum(n, 1)

    out, w = {}, np.zeros((len(scale) + 1, len(models)))
    for penalty in sorted(penalties, reverse=True):
        ahead, t = w.copy(), 1.0
        for _ in range(STEPS):
            moved = ahead - step * gradient(ahead)
            inner = moved[:-1]
            moved[:-1] = np.sign(inner) * np.maximum(np.abs(inner) - step * penalty * alpha, 0) / (1 + step * penalty * (1 - alpha))
            turned = ((ahead - moved) * (moved - w)).sum() > 0
            after = 1.0 if turned else (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = moved + (0 if turned else (t - 1) / after) * (moved - w)
            change, w, t = np.abs(moved - w).max() / max(1.0, np.abs(moved).max()), moved, after
            if change < TOLERANCE:
                break
        out |= {(*model, penalty): w[:, i].copy() for i, model in enumerate(models)}
    return out


def scored(m: Matrix, coefficients: dict[tuple[int, int, float, float], np.ndarray]) -> DataFrame:
    """(mixing, penalty, repeat, fold, label, score) of each row under each model that didn't train on it."""
    models = [k for k in coefficients if k[1] >= 0]
    w, scale = m.rows.sparkSession.sparkContext.broadcast(np.stack([coefficients[k] for k in models], axis=1)), m.deviation
    mean = m.mean

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                b = batch.slice(i, ROWS)
                p = 1 / (1 + np.exp(-np.clip(_dense(b, mean, scale) @ w.value, -30, 30)))
                row, at = np.nonzero(~_trains(b, models))
                kinds = (pa.float64(), pa.float64(), pa.int32(), pa.int32())
                told = [pa.array([models[k][j] for k in at], t) for j, t in zip((2, 3, 0, 1), kinds)]
                labels = np.asarray(b.column(1).to_numpy(zero_copy_only=False))[row]
                yield pa.RecordBatch.from_arrays([*told, pa.array(labels, pa.int32()), pa.array(np.round(p[row, at], 9))], ["mixing", "penalty", "repeat", "fold", "label", "score"])

    return m.rows.mapInArrow(run, "mixing double, penalty double, repeat int, fold int, label int, score double")


def areas_by(df: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """The exact area under the ROC curve of each group; null where a class is missing."""
    yes = F.sum((F.col(label) == 1).cast("long"))
    counts = df.groupBy(*keys, score).agg(yes.alias("_yes"), (F.count("*") - yes).alias("_no"))
    upto = running(counts, [*keys, F.desc(score)], {"_tp": "_yes"})
    base = upto.groupBy(*keys).agg(F.min(F.col("_tp") - F.col("_yes")).alias("_base"), F.sum("_yes").alias("_all_yes"), F.sum("_no").alias("_all_no"))
    area = F.sum(F.col("_no") * (2 * (F.col("_tp") - F.col("_base")) - F.col("_yes"))).cast("double") / 2
    pairs = F.max("_all_yes").cast("double") * F.max("_all_no")
    return upto.join(base, list(keys)).groupBy(*keys).agg(F.when(pairs > 0, area / pairs).alias("area"))


def tuned(docs: DataFrame, key: str, text: str, label: str, mixings: Sequence[float], penalties: Sequence[float], **options) -> tuple[DataFrame, dict]:
    """(mixing, penalty, area, sd, folds) by repeated cross-validation, and the coefficients."""
    m = matrix(docs, key, text, label, **options)
    found = fitted(m, mixings, penalties)
    by_fold = areas_by(scored(m, found), ["mixing", "penalty", "repeat", "fold"], "score", "label")
    return by_fold.groupBy("mixing", "penalty").agg(F.avg("area").alias("area"), F.stddev_samp("area").alias("sd"), F.count("area").alias("folds")), found
