"""Selection of certified rules against a plain computation, with strata too small for a rule of their own."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("quillspark.llm")
from quillspark.llm import quality  # noqa: E402

ALPHA, DELTA = Fraction(1, 100), Fraction(1, 20)


def at_most(k, n):
    """The exact probability of at most k false rejections of n at a share of ALPHA."""
    return sum(math.comb(n, i) * ALPHA**i * (1 - ALPHA) ** (n - i) for i in range(k + 1))


def plain(trials):
    """Rules by stratum: (certified, policy, good trials in the holdout)."""
    strata = sorted({t.stratum for t in trials})
    good = {s: sum(t.good and t.holdout for t in trials if t.stratum == s) for s in strata}
    enough = math.ceil(math.log(float(DELTA) / len(strata)) / math.log(1 - float(ALPHA)))
    rows = [(t.stratum if good[t.stratum] >= enough else "*", t) for t in trials]
    rules = sorted({s for s, t in rows if t.good and not t.holdout})
    out = {}
    for s in rules:
        mine = [t for stratum, t in rows if stratum == s]
        tuning = [t for t in mine if t.good and not t.holdout]
        policies = []
        for share in quality.TAILS:
            cut = []
            for name in quality.SIGNALS:
                values = [t[name] for t in tuning]
                cut.append(next(c for c in range(quality.GRID + 1) if sum(v >= c for v in values) <= share * len(tuning)))
            policies.append(cut)
        rejects = lambda t, g: any(any(t[name] >= c for name, c in zip(quality.SIGNALS, cut)) for cut in policies[: g + 1])
        held = [t for t in mine if t.good and t.holdout]
        passed = -1
        for g in range(len(policies)):
            if not held or at_most(sum(rejects(t, g) for t in held), len(held)) > DELTA / len(rules):
                break
            passed = g
        bad = [sum(rejects(t, g) for t in mine if not t.good and not t.holdout) for g in range(len(policies))]
        policy = next(g for g in range(passed + 1) if bad[g] >= quality.NEARLY * bad[passed]) if passed >= 0 else None
        out[s] = (passed >= 0, policy, len(held))
    return out


def test_selection(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(3_400):
        lang = "en" if i < 1_800 else ("de", "fr", "es")[i % 3]
        junk = rng.random() < 0.2
        marks = 12 if junk or lang == "en" and rng.random() < 0.001 else int(rng.random() < 0.1)
        words = [f"w{x}" for x in rng.integers(0, 10**6, 25)]
        words[:marks] = ["***" + w for w in words[:marks]]
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(not junk)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    marked = spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1)
    seen = quality.features(docs).cache()
    want = plain(quality.trials(seen, marked).collect())
    got = {s: (c["certified"], c["policy"], c["n"]) for s, c in quality.select(seen, marked).items()}
    assert got == want
    assert set(want) == {"en", "*"} and want["*"][0] and want["en"][0]
    result = quality.judged(docs, marked).collect()
    assert {r.stratum for r in result} == {"en", "*"} and all(r.n_holdout >= r.n_needed == quality.needed(2) for r in result)
    assert any(not r.kept and not r.base_failed for r in result if r.stratum == "*")


def test_a_pool_that_is_too_small_says_what_it_needs(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(25)), ("en", "de")[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.judged(docs, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")).collect()
    assert {(r.stratum, r.certified, r.policy, r.kept) for r in got} == {("*", False, None, True)}
    assert {r.n_needed for r in got} == {quality.needed(1)} and all(r.n_holdout < r.n_needed for r in got)
    assert quality.needed(1) == 299 and (1 - quality.ALPHA) ** 299 <= quality.DELTA < (1 - quality.ALPHA) ** 298
