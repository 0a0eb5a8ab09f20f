"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Test items are taken in blocks of a bounded size. For each block, one pass over the corpus counts
in how many documents each of the items' word n-grams occurs; an item's seeds are its n-grams
that are rare there (at most ``RARE`` of the documents), and never fewer than the rarer half of
them, so that an item which leaked often still has seeds. A second pass looks the seeds up in
every document, and aligns the item with the stretch of the document around each cluster of
seed hits. The score is the best local alignment's share of the item's own. Items with fewer than
``WORDS`` words must be there word for word, as part of one would be a common phrase.

All text is read. Words are runs of letters and digits, in lower case. Defined cases: null and
empty texts match nothing; items with a null text or fewer words than ``GRAM`` are not test
items; several rows of an item_id are several items; rows sharing a doc_id are searched each for
itself; an empty table on either side gives an empty result; columns beside ids and texts are not
read.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean, table

GRAM = 3
#: Items with fewer words leak only as whole copies; with fewer than ``GRAM``, they are no test items.
WORDS = 8
RARE = 1e-4
SCORE, SHORT_SCORE = 0.4, 1.0
#: Words of all items of a block at most, about 100 MB of seeds in a worker.
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -2

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Items:
    """A block of items: word ids, n-gram keys with their (item, position) places."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], np.int64) for _, ws in items]
        self.base = len(self.vocabulary) + 1
        keys = [self.keys_of(w)[1] for w in self.words]
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys])
        order = np.argsort(np.concatenate(keys), kind="stable")
        flat = np.concatenate(keys)[order]
        self.keys, self.first = np.unique(flat, return_index=True)
        self.last = np.append(self.first[1:], len(flat))
        self.owner, self.place = owner[order], place[order]

    def keys_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of the n-grams of known words."""
        n = len(ids) - GRAM + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = np.ones(n, bool)
        key = np.zeros(n, np.int64)
        for k in range(GRAM):
            part = ids[k : k + n]
            known &= part >= 0
            key = key * self.base + part
        at = np.flatnonzero(known)
        return at, key[at]

    def encode(self, text: str | None) -> np.ndarray:
        ws = words_of(text)
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in ws], np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, key index) of all n-grams that items have."""
        at, key = self.keys_of(ids)
        if not len(key):
            return at, key
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = self.keys[k] == key
        return at[ok], k[ok]

    def seeds(self, df: np.ndarray, n_docs: int) -> np.ndarray:
        """For each place in the lists, whether its n-gram is a seed of its item."""
        of = np.repeat(df, self.last - self.first)
        out = of <= max(1, RARE * n_docs)
        for i in range(len(self.ids)):
            mine = self._mine(i)
            out[mine] |= of[mine] <= np.median(of[mine])
        return out

    def _mine(self, i: int) -> np.ndarray:
        if not hasattr(self, "_by_owner"):
            self._by_owner = np.argsort(self.owner, kind="stable")
            self._bounds = np.searchsorted(self.owner[self._by_owner], np.arange(len(self.ids) + 1))
        return self._by_owner[self._bounds[i] : self._bounds[i + 1]]


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local score of two word sequences, and where it ends in ``text``.

    A row of the matrix at a time: gaps along the row are a running maximum.
    """
    slide = -GAP * np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + slide) - slide
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _aligned(items: _Items, ids: np.ndarray, at: np.ndarray, key: np.ndarray, seed: np.ndarray) -> list[tuple[int, float, int]]:
    """(item, score, end) of each item that one of its clusters of seed hits aligns well with."""
    places: dict[int, list[int]] = defaultdict(list)
    for pos, k in zip(at.tolist(), key.tolist()):
        for p in range(items.first[k], items.last[k]):
            if seed[p]:
                places[int(items.owner[p])].append(pos)
    out = []
    for i, found in places.items():
        item = items.words[i]
        m, best = len(item), (0, 0)
        lo = hi = found[0]
        for pos in [*found[1:], None]:
            if pos is not None and pos - hi <= m:
                hi = pos
                continue
            a = max(0, lo - 2 * m)
            score, end = smith_waterman(item, ids[a : hi + 2 * m])
            best = max(best, (score, a + end))
            lo = hi = pos if pos is not None else 0
        if best[0] >= (SCORE if m >= WORDS else SHORT_SCORE) * MATCH * m:
            out.append((i, best[0] / (MATCH * m), best[1]))
    return out


def _blocks(benchmark: DataFrame):
    """The items in blocks; only one block is on the driver at a time."""
    held, size = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        ws = words_of(r.text)
        if len(ws) >= GRAM:
            held.append((r.item_id, ws))
            size += len(ws)
        if size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score and the word where the alignment ends, of all pairs whose score
    reaches ``SCORE``, or ``SHORT_SCORE`` for short items."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, item_id long, score double, end_word long"
    out = spark.createDataFrame([], kind)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(items := _Items(block))

        def count(batches, shared=shared):
            items = shared.value
            df, n = np.zeros(len(items.keys), np.int64), 0
            for b in batches:
                for t in b.column(0).to_pylist():
                    _, key = items.hits(items.encode(t))
                    df[np.unique(key)] += 1
                    n += 1
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["k", "n"])

        found = text.select("text").mapInArrow(lean(count), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        by = dict(zip(found.column("k").to_pylist(), found.column("n").to_pylist()))  # at most the block's n-grams
        df = np.zeros(len(items.keys), np.int64)
        for k, n in by.items():
            if k >= 0:
                df[k] = n
        seeds = spark.sparkContext.broadcast(items.seeds(df, by.get(-1, 0)))

        def search(batches, shared=shared, seeds=seeds):
            items, seed = shared.value, seeds.value
            for b in batches:
                rows = []
                for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = items.encode(t)
                    at, key = items.hits(ids)
                    if len(at):
                        rows += [(doc, items.ids[i], score, end) for i, score, end in _aligned(items, ids, at, key, seed)]
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "score", "end_word"])

        out = out.union(text.mapInArrow(lean(search), kind))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with all their columns; rows without a doc_id stay."""
    leaked = fresh(docs, "leaked")[0]
    found = leaks(docs, benchmark).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(leaked), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
