"""Language identification as a mixture of languages.

Each language has likelihoods of letter trigrams (hashed to a fixed number of cells), counted in a
training sample. A text's trigrams are taken as drawn from a mixture of the languages;
expectation-maximisation estimates its proportions. Which languages it holds is chosen among the
nested sets of the k largest proportions by the penalised likelihood: log likelihood, discounted
as neighbouring trigrams overlap, minus a penalty a language that grows with the text's length.
The prediction is the largest proportion of the chosen set, the score that proportion.

The training rows are at most about ``SAMPLE``, chosen by hash; every text is predicted whole.
Defined cases: texts that are null or without a letter are ``und`` with score 0; rows with a null
language or doc_id are not learned from; a null doc_id isn't held out; the smallest name wins
ties; without training rows every prediction is ``und``; rows sharing a doc_id are predicted
each for itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, sampled, stored, table

SAMPLE = 20_000
CELLS = 1 << 15
#: Languages at most, as CELLS * LANGUAGES bounds what is broadcast; more are an error.
LANGUAGES = 200
ROUNDS = 12
#: A language costs so many halves of the logarithm of the number of trigrams.
PENALTY = 3.0
OVERLAP = 3.0
SMOOTH = 0.5

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def cells(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a text's letter trigrams and their counts; words are bounded by a blank."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.pad(code * _letters()[code], 1)
    mid = code[1:-1]
    h = (code[:-2] * np.uint32(2654435761) ^ mid * np.uint32(2246822519) ^ code[2:] * np.uint32(3266489917))[mid > 0]
    h = (h ^ h >> np.uint32(15)) * np.uint32(668265263)
    n = np.bincount(h >> np.uint32(17), minlength=CELLS)
    at = np.flatnonzero(n)
    return at, n[at]


def train(docs: DataFrame, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray] | None:
    """The languages in order, and the likelihood of each cell in each of them."""
    some = docs.where("lang is not null and doc_id is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "lang", "text")
    some = sampled(some, "doc_id", SAMPLE)

    def count(batches):
        by: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, n = cells(t)
                by.setdefault(lang, np.zeros(CELLS, np.int64))[at] += n
                if len(by) > languages:
                    yield from out(by)
                    by = {}
        yield from out(by)

    def out(by):
        for lang, n in by.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "cell", "n"])

    sums = some.select("lang", "text").mapInArrow(lean(count), "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    sums, path = stored(sums, "cells")
    names = sorted(r.lang for r in sums.select("lang").distinct().limit(languages + 1).collect())
    if len(names) > languages:
        raise ValueError(f"there are more than {languages} languages; raise the argument, or map the codes")
    got = sums.toArrow()  # at most CELLS rows a language
    discard(docs.sparkSession, path)
    if not names:
        return None
    model = np.full((CELLS, len(names)), SMOOTH)
    index = {x: i for i, x in enumerate(names)}
    np.add.at(model, (got.column("cell").to_numpy(), [index[x] for x in got.column("lang").to_pylist()]), got.column("n").to_numpy())
    return names, (model / model.sum(axis=0)).astype(np.float64)


def _em(p: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        share = share * ((n / (p @ share)) @ p)
        share /= share.sum()
    return share, float(n @ np.log(p @ share))


def mixture(p: np.ndarray, n: np.ndarray) -> tuple[list[int], list[float]]:
    """The chosen languages and their proportions, largest first."""
    total = n.sum()
    cost = PENALTY * 0.5 * np.log(total + 1)
    full, most = _em(p, n, ROUNDS)
    order = np.argsort(-full, kind="stable")
    alone = n @ np.log(p)
    first = int(alone.argmax())
    best, value = ([first], [1.0]), alone[first] / OVERLAP - cost
    if most / OVERLAP - 2 * cost > value:
        for k in range(2, p.shape[1] + 1):
            if most / OVERLAP - k * cost <= value:  # no larger set can be better
                break
            chosen = order[:k]
            share, like = (full[chosen] / full[chosen].sum(), most) if k == p.shape[1] else _em(p[:, chosen], n, ROUNDS)
            if like / OVERLAP - k * cost > value:
                by = np.argsort(-share, kind="stable")
                best, value = ([int(chosen[i]) for i in by], [float(share[i]) for i in by]), like / OVERLAP - k * cost
    return best


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and all languages found with their proportions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            out: list[tuple[str, float, str]] = []
            for t in b.column(2).to_pylist():
                at, n = cells(t) if model else ((), ())
                if not len(at):
                    out.append(("und", 0.0, ""))
                    continue
                names, p = model
                langs, share = mixture(p[at], n)
                out.append((names[langs[0]], share[0], ",".join(f"{names[i]}:{s:.3f}" for i, s in zip(langs, share))))
            lang, score, all_ = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(all_, pa.string())], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, languages string")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return predict(docs, train(docs))
