"""Quality rules with risk-controlled thresholds.

Signals of each text are put on fixed grids. Labelled rows are the trials: one for each family of
near copies (rows that have the smallest of their word-shingle hashes in common; the smallest
doc_id stands for it), so that copies are neither several trials nor on both sides of the split,
which is by a hash of the family. In each stratum (language) the tuning half proposes a sequence
of policies, from one that rejects nothing to ever stricter ones; a policy has one cutoff a signal,
at the same tail share of the good tuning rows. The holdout certifies policies in this order: a
policy passes when the exact binomial test rejects "it falsely rejects more than ALPHA of good
rows", that is when the Clopper-Pearson upper bound is at most ALPHA; the first failure ends the
sequence (fixed-sequence testing, so a stratum's error is one level), and the level DELTA is
divided by the number of strata (Bonferroni). Of the certified policies the mildest is taken that
rejects nearly as many bad tuning rows as the best. With probability 1 - DELTA no stratum loses
more than ALPHA of its good rows, as far as families are independent draws.

A certificate needs about ln(rules / DELTA) / ALPHA good families in the holdout (some 450 for four
rules). Strata that have fewer can't get one of their own, whatever their signals say; with those that
have less than one in POOL of the labelled rows, or no labels, they are judged together as the stratum
``*``. Its certificate holds for the pool: of its good rows, taken together, no more than ALPHA are
lost; it says nothing of a single language in it. Which strata are pooled depends on numbers of trials
alone, so the tests stay valid, and there are at most POOL + 1 rules. Where the pool has too few as well,
it keeps whatever the base rule keeps. The result says so for every row: stratum (the rule's; a language
of the name ``*`` is in the pool), certified, policy (its number; null without), n_holdout (good
trials), n_needed (those that a certificate takes) and bound.

Everything but a bounded table of grid counts stays distributed. Defined cases: null and empty
texts have no words and fail the base rule; labels without a doc_id or quality are not used, and of
several labels of a doc_id the worst counts; rows without a language form a stratum; rows that share
a doc_id are judged each for itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, mix64, stored, table, word_hashes

ALPHA, DELTA = 0.01, 0.05
POOL = 1_000
REST = "*"
#: Words of the shingles by which near copies are told.
SHINGLE = 5
GRID = 64
#: Tail shares of good tuning rows at which policies cut.
TAILS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01)
#: A milder policy is taken if it rejects this share of what the best one rejects.
NEARLY = 0.98
SIGNALS = ("symbols", "dup_lines", "repeats", "exclaims", "long_words", "short_words")
_SPACES = " \t\n\x0b\x0c\r"

def _features(text: str) -> tuple[int, int, int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    repeated = 0
    if n >= 8:
        windows = list(zip(*(words[i:] for i in range(8))))
        seen: set = set()
        twice = {w for w in windows if w in seen or seen.add(w)} if len(set(windows)) < len(windows) else ()
        if twice:
            end = 0
            for i, w in enumerate(windows):
                if w in twice:
                    repeated += i + 8 - max(i, end)
                    end = i + 8
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), text.count("!")

def family(text: str) -> int:
    """The smallest hash of the text's shingles, which near copies mostly share; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = word_hashes(words)
    k = min(SHINGLE, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return int(out.min().astype(np.int64))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, counts, the family and the grid cell of each signal (higher is worse)."""

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            x = np.array([_features(t or "") for t in texts], np.int64).reshape(-1, 7)
            families = pa.array([family(t or "") for t in texts], pa.int64())
            n, chars, symbols, dups, repeated, lines, bangs = x.T
            size = chars / np.maximum(n, 1)
            cell = lambda v: np.clip(np.floor(v * GRID), 0, GRID - 1).astype(np.int32)
            cells = [cell(symbols / np.maximum(chars, 1)), cell(dups / np.maximum(lines, 1)), cell(repeated / np.maximum(n, 1)), cell(bangs / np.maximum(n, 1)), cell(size / 32), cell(1 - size / 16)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v) for v in (n, chars, symbols, dups, repeated)), families, *(pa.array(c) for c in cells)], ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "family", *SIGNALS])

    kind = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, family long, " + ", ".join(f"{s} int" for s in SIGNALS)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("stratum"), "text").mapInArrow(lean(run), kind)

def tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exactly summed in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))

def upper_bound(k: int, n: int, level: float) -> float:
    """The Clopper-Pearson upper bound of a share at confidence 1 - level."""
    if k >= n:
        return 1.0
    lo, hi = k / n if n else 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(k, n, mid) > level else (lo, mid)
    return hi

BASE = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def trials(seen: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, good, holdout and the signals of one labelled row of each family that passes the base rule."""
    graded = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = seen.where(f"not ({BASE})").join(graded, "doc_id")
    one = rows.groupBy("family").agg(F.min(F.struct("doc_id", "stratum", "quality", *SIGNALS)).alias("x"))
    return one.select("x.stratum", (F.col("x.quality") > 0).alias("good"), (F.pmod(F.xxhash64("family", F.lit(101)), F.lit(2)) == 1).alias("holdout"), *[f"x.{c}" for c in SIGNALS])


def _pooled(df: DataFrame, own: list[str]) -> DataFrame:
    """Strata that have no rule of their own become one."""
    return df.withColumn("stratum", F.when(F.col("stratum").isin(own), F.col("stratum")).otherwise(REST))


def needed(rules: int, alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Good trials in the holdout without which no policy of one of so many rules can be certified."""
    return math.ceil(math.log(delta / max(rules, 1)) / math.log1p(-alpha))


def select(seen: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict]:
    """For each stratum its certificate: certified, the cutoffs (a row is rejected at a cell >= its
    cutoff; GRID rejects nothing), the number of the policy, the number of good trials and the bound."""
    spark = seen.sparkSession
    rows, path = stored(trials(seen, labels), "labelled")
    least = max(1, rows.count() // POOL)
    trials_of = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.sum((F.col("good") & F.col("holdout")).cast("long")).alias("good"))
    large = trials_of.where(F.col("n") >= least).collect()  # at most POOL
    own = [r.stratum for r in large if r.good >= needed(len(large), alpha, delta)]
    rows = _pooled(rows, own)
    cells = rows.where("good and not holdout").select("stratum", F.posexplode(F.array(*SIGNALS)).alias("signal", "cell"))
    counts: dict = {}
    for r in cells.groupBy("stratum", "signal", "cell").count().collect():
        counts.setdefault(r.stratum, np.zeros((len(SIGNALS), GRID), np.int64))[r.signal, r.cell] = r["count"]
    policies = {}
    for s, c in counts.items():
        above = np.cumsum(c[:, ::-1], axis=1)[:, ::-1]  # good rows at a cell or above
        total = c[0].sum()
        # the lowest cutoff that at most the tail share of good rows reaches; GRID: none
        policies[s] = [[int(np.argmax(np.append(above[i], 0) <= t * total)) for i in range(len(SIGNALS))] for t in TAILS]
    if not policies:
        discard(spark, path)
        return {}

    # the first policy that rejects a row
    listed = spark.createDataFrame(sorted(policies.items()), "stratum string, policies array<array<int>>")
    hits = F.transform("policies", lambda p: F.exists(F.zip_with(F.array(*SIGNALS), p, lambda x, cut: x >= cut), lambda x: x))
    first = F.array_position(hits, True) - 1
    rejected = rows.join(F.broadcast(listed), "stratum").withColumn("first", F.when(first < 0, len(TAILS)).otherwise(first))
    table_: dict = {}
    for r in rejected.groupBy("stratum", "holdout", "good", "first").count().collect():
        table_.setdefault((r.stratum, r.holdout, r.good), np.zeros(len(TAILS) + 1, np.int64))[r["first"]] = r["count"]
    discard(spark, path)
    out = {}
    for s in policies:
        wrong, bad = (np.cumsum(table_.get((s, hold, good), np.zeros(len(TAILS) + 1, np.int64))) for hold, good in ((True, True), (False, False)))
        n, passed = int(wrong[-1]), -1
        for g in range(len(TAILS)):
            if n == 0 or tail(int(wrong[g]), n, alpha) > delta / len(policies):
                break
            passed = g
        if passed < 0:
            out[s] = {"certified": False, "cutoffs": [GRID] * len(SIGNALS), "policy": None, "n": n, "bound": None, "needed": needed(len(policies), alpha, delta)}
            continue
        g = next(g for g in range(passed + 1) if bad[g] >= NEARLY * bad[passed])
        out[s] = {"certified": True, "cutoffs": policies[s][g], "policy": g, "n": n, "bound": upper_bound(int(wrong[g]), n, delta / len(policies)), "needed": needed(len(policies), alpha, delta)}
    return out


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The counts, base_failed and kept of each row, and the certificate of its stratum's rule."""
    seen, _ = stored(features(docs), "quality")
    chosen = select(seen, labels, alpha, delta)
    rules = [(s, c["certified"], c["cutoffs"], c["policy"], c["n"], c["bound"], c["needed"]) for s, c in sorted(chosen.items())]
    rules = docs.sparkSession.createDataFrame(rules, "stratum string, certified boolean, cutoffs array<int>, policy int, n_holdout long, bound double, n_needed long")
    out = _pooled(seen, [s for s in chosen if s != REST]).join(F.broadcast(rules), "stratum", "left")
    rejected = F.coalesce(F.exists(F.zip_with(F.array(*SIGNALS), "cutoffs", lambda x, cut: x >= cut), lambda x: x), F.lit(False))
    out = out.withColumn("base_failed", F.expr(BASE)).withColumn("kept", ~F.col("base_failed") & ~rejected)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", F.coalesce("certified", F.lit(False)).alias("certified"), "policy", F.coalesce("n_holdout", F.lit(0).cast("long")).alias("n_holdout"), F.coalesce("n_needed", F.lit(needed(1, alpha, delta)).cast("long")).alias("n_needed"), "bound")


def query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
