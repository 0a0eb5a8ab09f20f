"""Toxicity: cumulative-link ordinal regression on sparse words.

P(grade >= k) = logistic(w.x - b_k): one weight vector for all thresholds b_1 <= b_2 <= ...;
expected severity is the sum of these probabilities. Features are the words (lower case) and word
beginnings of 3 to 7 letters (stems, so that inflected forms share a weight) whose document
frequency differs most between the lowest grade and the others in the training rows, as
log(1 + count).

The classifier is fitted on a sample of at most about ``SAMPLE`` labelled rows and ``FEATURES``
words; every document is scored, over its whole text. Grades come from ``labels``: 0 where
``toxic`` is 0, 1 where it is 1, and 2 where besides ``quality`` is 0, as far as such rows exist.

Defined cases: null and empty texts score as texts without words; labels with a null or unknown
doc_id or a null ``toxic`` are not used; several labels of a row count with their highest grade;
without labels of two grades every document gets the severity 0; rows sharing a doc_id are scored each for itself; other columns are kept and not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, lean, sampled, stored, table

#: Labelled rows the classifier is fitted on, and its features, at most, roughly.
SAMPLE = 30_000
FEATURES = 512
LEAST_DF = 5
#: A word's frequency must differ by so many standard errors.
LEAST_Z = 5.0
#: A document is toxic from this probability of grade 1 or more.
TOXIC = 0.5

WORDS = re.compile(r"[^\W\d_]+")
STEMS = range(3, 8)


def forms(word: str) -> list[str]:
    """The features of a word: itself and its beginnings, which end in a hyphen."""
    return [word, *(word[:k] + "-" for k in STEMS if k <= len(word))]


class _Found(dict):
    """Word to the positions of its features, remembered up to a bound."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        self[word] = got = tuple(self.index[f] for f in forms(word) if f in self.index)
        return got

    def count(self, text: str | None) -> Counter:
        return Counter(i for at in map(self.__getitem__, WORDS.findall((text or "").lower())) if at for i in at)


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, f: int, y: np.ndarray, grades: int, ridge: float = 1.0, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """From the sparse matrix of ``f`` columns (row, column, value) and the grades 0, 1, ...: weights and the increasing thresholds by maximum likelihood with a ridge on the weights.

    Thresholds are a first value and positive steps, so their order holds throughout; the
    optimiser is Adam over the whole batch, from a fixed start.
    """
    n = len(y)
    share = np.array([(y >= k).mean() for k in range(1, grades)]).clip(1e-6, 1 - 1e-6)
    b = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(f), b[:1], np.log(np.maximum(np.diff(b), 1e-3))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, cuts = theta[:f], np.cumsum(np.concatenate([theta[f : f + 1], np.exp(theta[f + 1 :])]))
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[col], n)[:, None] - cuts[None, :], -30, 30)))
        full = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])  # P(grade >= k) for k = 0 .. grades
        at = np.arange(n)
        mass = np.maximum(full[at, y] - full[at, y + 1], 1e-12)
        slope = full * (1 - full)
        # d mass / d (w.x) and its parts by the upper and the lower threshold
        up, down = slope[at, y] / mass, slope[at, y + 1] / mass
        grad_w = -np.bincount(col, value * (up - down)[row], f) + ridge * w
        grad_b = np.array([(up * (y == k)).sum() - (down * (y == k - 1)).sum() for k in range(1, grades)])
        later = np.cumsum(grad_b[::-1])[::-1]  # a step moves its threshold and all above
        grad = np.concatenate([grad_w, later[:1], later[1:] * np.exp(theta[f + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:f], np.cumsum(np.concatenate([theta[f : f + 1], np.exp(theta[f + 1 :])]))


def _grades(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    return labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(grade).alias("grade"))


def train(docs: DataFrame, graded: DataFrame) -> dict | None:
    """The model as {words, weights, cuts}, from (doc_id, grade); None without two grades."""
    some = sampled(graded, "doc_id", SAMPLE)  # bounded, so it may be broadcast
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    # copies of one text with one grade count once; stored, as it is read three times
    joined, path = stored(joined.dropDuplicates(["text", "grade"]).select("text", "grade"), "graded")
    try:
        return _trained(joined)
    finally:
        discard(docs.sparkSession, path)


def _trained(joined: DataFrame) -> dict | None:

    def counts(batches):
        df: dict[int, Counter] = {}

        def out():
            for g, c in df.items():
                yield pa.RecordBatch.from_pydict({"word": list(c), "grade": pa.array([g] * len(c), pa.int32()), "n": list(c.values())})
            df.clear()

        for b in batches:
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = {*WORDS.findall((t or "").lower())}
                df.setdefault(g, Counter()).update({f for w in words for f in forms(w)} | {""})
                if sum(map(len, df.values())) > 200_000:
                    yield from out()
        yield from out()

    df = joined.mapInArrow(lean(counts), "word string, grade int, n long").groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.expr("if(grade > 0, n, 0)")).alias("bad")).where(f"n >= {LEAST_DF} or word = ''")
    totals = df.where("word = ''").first()
    if totals is None or not 0 < totals.bad < totals.n:
        return None
    bad, good = totals.bad, totals.n - totals.bad
    p, q = F.col("bad") / bad, (F.col("n") - F.col("bad")) / good
    both = F.col("n") / totals.n
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / bad + 1 / good) + 1e-12)
    best = df.where("word <> ''").withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "word").limit(FEATURES).collect()
    words = sorted(r.word for r in best)
    if not words:
        return None
    index = {w: i for i, w in enumerate(words)}

    def features(batches):
        known = _Found(index)
        for b in batches:
            found = [known.count(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["grade", "at", "n"])

    rows = joined.mapInArrow(lean(features), "grade int, at array<int>, n array<int>").toArrow()
    at = rows.column("at").combine_chunks()
    row, col = np.repeat(np.arange(rows.num_rows), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()
    value = np.log1p(rows.column("n").combine_chunks().flatten().to_numpy())
    y = rows.column("grade").to_numpy()
    present = np.unique(y)
    w, cuts = fit(row, col, value, len(words), np.searchsorted(present, y), len(present))
    return {"words": words, "weights": w.tolist(), "cuts": cuts.tolist(), "grades": present.tolist()}


RESULTS = ("expected_severity", "p_toxic", "toxic")


def score(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """Add expected_severity, p_toxic and toxic to all rows; columns of these names are replaced.

    The severity is that of the grades the model was fitted on; by ``_grades``, the highest stands
    for toxic rows of low quality, as the labels know no other degree."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS and c != text])
    return _scored(docs, model, text, RESULTS)


def _scored(docs: DataFrame, model: dict | None, text: str, results: Sequence[str]) -> DataFrame:
    names = docs.columns
    if model is None:
        return docs.withColumns(dict(zip(results, (F.lit(0.0), F.lit(0.0), F.lit(False)))))
    index, weights = {w: i for i, w in enumerate(model["words"])}, model["weights"]
    cuts, steps = np.array(model["cuts"]), np.diff(model["grades"])
    at = names.index(text)

    def run(batches):
        known = _Found(index)
        for b in batches:
            s = [sum(weights[i] * math.log1p(n) for i, n in sorted(known.count(t).items())) for t in b.column(at).to_pylist()]
            p = 1 / (1 + np.exp(-(np.array(s, float).reshape(-1, 1) - cuts)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p @ steps), pa.array(p[:, 0]), pa.array(p[:, 0] >= TOXIC)], [*names, *results])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    severity, p_toxic, toxic = results
    return docs.mapInArrow(lean(run), f"{kinds}, {severity} double, {p_toxic} double, {toxic} boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, _grades(table(spark, sf_dir, "labels")))
    return score(docs.select("doc_id", "text"), model).drop("text")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model, fitted on those of them that have labels, doesn't reject."""
    results = fresh(docs, *RESULTS)
    out = _scored(docs, train(docs, _grades(labels)), "text", results)
    return out.where(~F.col(results[-1])).select(*docs.columns)
