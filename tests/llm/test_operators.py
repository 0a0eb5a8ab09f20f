"""Each operator against a brute-force version, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm")
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quillspark.llm import decontamination, graph, jaccard_join, language, packing, privacy, quality, secrets, sharding, token_files, tokens, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, length int, kept string"
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def awkward(spark):
    """Null and empty texts, repeated rows, shared and missing ids, a long text, clashing columns."""
    words = " ".join(f"w{i * 7919 % 1000}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "token = 'abcdefgh12' a@b.example.com"), (None, "nothing here"), (None, None), (6, words), (7, "ok 😀 é " * 50)]
    return spark.createDataFrame([(i, t, "en" if i != 4 else None, None, len(t or ""), 0.5, 3, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# --- tokens -----------------------------------------------------------------------------------
@pytest.mark.parametrize("file", [BYTE, WORD])
def test_encoder_is_exact(file, texts):
    rng = np.random.default_rng(5)
    letters = list("ab cd'sé ß\n\t  \x1c\x85\xa0Zz09²½ªº.!<|*中文😀éİſKµÿ")
    odd = ["".join(rng.choice(letters, rng.integers(40))) for _ in range(3_000)] + ["a <|endoftext|>b c", "it's we'll 'S", "x" * 300]
    whole, mine = Tokenizer.from_file(file), tokens.Encoder(file)
    for t in [*odd, *texts.values()]:
        assert mine.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, t[:80]


def test_token_files_round_trip(spark, awkward, empty, tmp_path):
    parts = token_files.write(awkward, f"file://{tmp_path}/a", WORD, sequence=64, rows=4)
    got = token_files.read_digests(spark, parts).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "", r.doc_id) for r in awkward.collect()))
    start, whole = 0, Tokenizer.from_file(WORD)
    for r, (*_, text, doc) in zip(got, rows, strict=True):
        ids = whole.encode(text, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for file, _, n in parts:
        f = token_files.TokenFile(file)
        if n:
            assert len(f.sequence(0)) == 64
            last = (n - 1) // 64
            assert sum(f.mask(last).to_pylist()) == n - 64 * last
            assert np.array_equal(f.ids(0, n), np.concatenate([f.sequence(i) for i in range(last + 1)])[:n])
    assert token_files.read_digests(spark, token_files.write(empty, f"file://{tmp_path}/b", WORD)).count() == 0


# --- packing ----------------------------------------------------------------------------------
def test_fullest_bin_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(200):
        cap = int(rng.integers(5, 40))
        left = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, cap + 1, rng.integers(1, 6))}
        sums = {max(left)}
        for x, n in left.items():
            sums |= {s + k * x for s in sums for k in range(n - (x == max(left)) + 1) if s + k * x <= cap}
        uses = packing.fullest(dict(left), cap)
        assert sum(x * n for x, n in uses.items()) == max(sums)
        assert all(n <= left[x] for x, n in uses.items())


def test_plan_packs_everything():
    counts = {3: 1000, 5: 700, 9: 3, 10: 2}
    bins = packing.plan(counts, 10)
    for x, n in counts.items():
        assert sum(uses.get(x, 0) * times for uses, times in bins) == n
    assert sum(t for _, t in bins) <= math.ceil(sum(x * n for x, n in counts.items()) / 10) * 1.12


def test_packed_documents(spark, awkward, empty):
    rows = packing.packed(awkward, BYTE, 64).collect()
    whole = Tokenizer.from_file(BYTE)
    want = sorted(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in awkward.collect())
    assert sum(want) == sum(r.length for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert all(r.length == 64 for r in rows if r.piece)
    assert packing.packed(empty, BYTE).count() == 0


def test_sequences_hold_the_ids(spark, docs):
    found = packing.pieces(docs.limit(20), BYTE, 128, with_ids=True)
    placed = packing.pack(found.cache(), 128)
    for r in packing.sequences(placed).join(placed.groupBy("sequence_id").agg(F.sum("length").alias("n")), "sequence_id").collect():
        assert len(r.ids) == r.n <= 128


# --- quality ----------------------------------------------------------------------------------
def test_quality_counts(spark, docs, texts, awkward, empty):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = {x for x in windows if windows.count(x) > 1} if len(windows) < 3_000 else {x for x in set(windows) if windows.count(x) > 1}
        inside = {i + k for i, x in enumerate(windows) if x in many for k in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for r in quality.judged(docs, labels).collect():
        want = brute(texts[r.doc_id])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judged(awkward.where("doc_id is null or doc_id < 6"), labels.limit(0)).count() == 8
    assert quality.judged(empty, labels).count() == 0


def test_binomial_bound():
    brute = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in ((0, 10, 0.1), (3, 40, 0.05), (10, 10, 0.5)):
        assert quality.tail(k, n, p) == pytest.approx(brute(k, n, p))
    u = quality.upper_bound(3, 100, 0.05)
    assert brute(3, 100, u) == pytest.approx(0.05, abs=1e-6)


def test_certified_rules_reject_junk(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(6_000):
        junk = i % 5 == 0
        rows.append((i, " ".join(f"{'***' if junk else ''}word{x}" for x in rng.integers(0, 10**6, 30)), "en"))
        labels.append((i, 0 if junk else 1))
    seen = quality.features(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    chosen = quality.select(seen, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert chosen["en"]["certified"] and chosen["en"]["bound"] <= quality.ALPHA
    kept = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r.kept for r in kept.collect()}
    assert not any(got[i] for i in range(0, 6_000, 5))
    assert sum(not got[i] for i in range(6_000) if i % 5) <= 0.01 * 4_800


def test_copies_are_one_trial(spark):
    """A thousand copies of one good text certify nothing, and lie on one side of the split."""
    rng = np.random.default_rng(15)
    text = " ".join(f"word{x}" for x in rng.integers(0, 10**6, 60))
    rows = [(i, text + (f" end{i}" if i % 2 else ""), "en") for i in range(2_000)]
    seen = quality.features(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(i, 1) for i in range(2_000)], "doc_id long, quality int")
    assert quality.trials(seen, labels).count() <= 20
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)
    assert {(r.certified, r.kept, r.policy) for r in got.collect()} == {(False, True, None)}


def test_the_bound_holds_with_copies(spark):
    """Strata of good rows with a known false rejection share: the certified cutoffs stay below it."""
    rng = np.random.default_rng(16)
    rows, labels = [], []
    for i in range(9_000):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 30)]
        if rng.random() < 0.05:  # good rows that look like junk
            words[:12] = ["***" + w for w in words[:12]]
        rows += [(i, " ".join(words), "aa" if i % 3 else "bb")] + ([(10**6 + i, " ".join(words), "aa")] if i % 5 == 0 else [])
        labels += [(i, 1), (10**6 + i, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    for stratum in ("aa", "bb"):
        mine = [r for r in got if r.stratum == stratum]
        assert mine[0].certified and mine[0].bound <= quality.ALPHA
        assert sum(not r.kept for r in mine) <= quality.ALPHA * len(mine)


def test_query_of_quality(spark, docs, texts, empty):
    """kept, recomputed from the stated certificates."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    cells = {r.doc_id: r for r in quality.features(docs).collect()}
    rules = quality.select(quality.features(docs), labels)
    for r in quality.query(spark, SF).collect():
        x, rule = cells[r.doc_id], rules.get(r.stratum)
        hit = rule is not None and any(x[s] >= c for s, c in zip(quality.SIGNALS, rule["cutoffs"]))
        assert r.kept == (not r.base_failed and not hit)
        assert r.certified == bool(rule and rule["certified"]) and r.stratum in (x.stratum, quality.REST)
    assert quality.select(quality.features(empty), labels) == {}


# --- Jaccard join -----------------------------------------------------------------------------
def brute_components(texts, words, num, den):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b])):
                same = len(sets[a] & sets[b])
                if den * same >= num * (len(sets[a]) + len(sets[b]) - same):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize(("words", "num"), [(4, 85), (5, 80)])
def test_join_is_exact(spark, words, num, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)  # also large clusters, in blocks
    monkeypatch.setattr(jaccard_join, "LIST", 5)  # and families
    rng = np.random.default_rng(words)
    base = [[f"w{x}" for x in rng.integers(0, 5_000, rng.integers(1, 120))] for _ in range(12)]
    common = [f"c{x}" for x in range(40)]
    texts = {}
    for i in range(150):
        b = list(base[int(rng.integers(len(base)))])
        for _ in range(int(rng.integers(0, 4))):
            b[int(rng.integers(len(b)))] = f"z{rng.integers(10**6)}"
        texts[i] = " ".join(b + (common if i % 3 == 0 else []))
    got = jaccard_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, words, num, 100)


@pytest.mark.parametrize("block", [6, 2_000])
def test_join_counts_all_links(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LIST", 5)
    rng = np.random.default_rng(block)
    base = [[f"w{x}" for x in rng.integers(0, 5_000, 90)] for _ in range(6)]
    texts = {}
    for i in range(120):
        b = list(base[i % 6])
        for _ in range(int(rng.integers(0, 4))):
            b[int(rng.integers(len(b)))] = f"z{rng.integers(30)}"
        texts[i] = " ".join(b)
    texts |= {200: "", 201: None, 202: "alone", 203: texts[0], 204: texts[0]}
    got = jaccard_join.join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4, 85, 100, counted=True).collect()
    sets = {i: {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if (w := (t or "").split()) else set() for i, t in texts.items()}
    linked = lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b)
    brute = {i: sum(bool(linked(sets[i], sets[j])) for j in sets if j != i) for i in sets}
    assert {r.doc_id: r.n_links for r in got} == brute
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components({i: t or "" for i, t in texts.items()}, 4, 85, 100)
    assert 0 < max(brute.values()) < 20 + 2  # groups are not complete: links differ from group sizes
    assert any(0 < n < 19 for n in brute.values())


def test_merging_and_probing_find_links():
    rng = np.random.default_rng(12)
    base = [np.unique(rng.integers(0, 2**40, 150)) for _ in range(8)]
    sets = []
    for i in range(160):
        mine = rng.choice(base[i % 8], 130, replace=False)
        sets.append(np.unique(np.concatenate([mine, rng.integers(0, 2**40, int(rng.integers(0, 12)))])).astype(np.uint64))
    tally = Counter()
    found = jaccard_join.divide_skip(sets, [2] * len(sets), 70, 100, tally)
    assert tally["merged"] > 0 and tally["probed"] > 0
    same = lambda a, b: len(np.intersect1d(a, b))
    linked = lambda i, j: 100 * (c := same(sets[i], sets[j])) >= 70 * (len(sets[i]) + len(sets[j]) - c)
    assert all(linked(i, j) for i, j in found)
    group = list(range(len(sets)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in found:
        group[max(top(i), top(j))] = min(top(i), top(j))
    assert not any(linked(i, j) and top(i) != top(j) for i in range(len(sets)) for j in range(i))


def test_join_awkward(spark, awkward, empty):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_join.join(awkward.where("doc_id is null or doc_id <> 6"), 4, 85, 100).collect())
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 5), (-1, 1, None), (-1, 0, None), (7, 3, 7)])
    assert jaccard_join.join(empty, 4, 85, 100).count() == 0
    counted = jaccard_join.join(awkward, 4, 85, 100, counted=True).collect()
    assert sorted((r.doc_id or -1, r.n_links) for r in counted) == sorted([(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 0), (-1, 0), (-1, 0), (6, 0), (7, 0)])
    assert jaccard_join.join(empty, 4, 85, 100, counted=True).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


# --- decontamination --------------------------------------------------------------------------
def brute_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 2, h[i, j - 1] - 2)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(-1, 5, rng.integers(1, 20))
        assert decontamination.smith_waterman(a, b)[0] == brute_alignment(a, b)


def test_leaks_and_edits_are_found(spark, awkward, empty):
    rng = np.random.default_rng(6)
    prose = lambda n: [f"v{x}" for x in rng.integers(0, 3_000, n)]
    items = {i: prose(30) for i in range(20)}
    rows, want = [], set()
    for i in range(200):
        text = prose(150)
        if i % 4 == 0:
            item = list(items[i % 20])
            for _ in range(5):
                item[int(rng.integers(30))] = "edited"
            text[60:60] = item
            want.add((i, i % 20))
        rows.append((i, " ".join(text).capitalize() + "."))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None), (98, "too short")], "item_id long, text string")
    got = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert decontamination.leaks(awkward, bench).count() == 0
    assert decontamination.leaks(empty, bench).count() == decontamination.leaks(awkward, bench.limit(0)).count() == 0
    assert decontamination.clean(awkward, bench).columns == awkward.columns


def test_short_items_leak_as_whole_copies(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "What is the capital of France?"), (3, "one two three four five six seven"), (4, "too short"), (5, "a b c d e f g h")]
    rows = [(1, "He asked: who wrote Hamlet? Nobody knew."), (2, "what is the capital of Spain"), (3, "So WHAT is the, capital of France"), (4, "one two three four five six seven"), (5, "one two three four five six eight"), (6, "too short"), (7, "who wrote, long ago, hamlet"), (8, "a b c d x f g h"), (9, None)]
    found = decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (3, 2), (4, 3), (8, 5)}


# --- secrets ----------------------------------------------------------------------------------
def base_spans(t):
    found = [("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    return sorted((m.start(), r, k, m.end()) for r, (k, rx, ok) in enumerate(found) for m in re.finditer(rx, t) if ok(m))


def test_base_spans(spark):
    texts = ["😀 PassWord: 'hunter22x' token=secret:abcdefgh", "api_key = short secret==" + "x" * 9, "AKIA" + "B" * 12 + " AKIAshort", "é " + "0af" * 12, "secret: token = abcdefgh.ij", None, "", "apikey" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df).orderBy("doc_id").collect():
        assert [(s.start, s.rank, s.kind, s.stop) for s in r.secrets if s.rank < 3] == base_spans(texts[r.doc_id] or "")


def test_random_strings_are_discoveries(spark, awkward, empty):
    import base64

    rng = np.random.default_rng(8)
    keys = [base64.b64encode(rng.bytes(36)).decode() for _ in range(40)]
    words = ["internationalization_of_everything", "AbstractSingletonProxyFactoryBean", "usr/local/lib/python/site-packages", "12345678901234567890123"]
    rows = [(i, f"see {k} end") for i, k in enumerate(keys)] + [(100 + i, f"see {w} end") for i, w in enumerate(words * 5)]
    got = {r.doc_id: len(r.secrets) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(40)) >= 34
    assert not any(got[100 + i] for i in range(20))
    out = secrets.redact(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    assert out.where("doc_id = 5").first().text == "[SECRET]' a@b.example.com"
    assert secrets.redact(empty).count() == 0


def test_each_encoding_is_discovered(spark):
    import random
    import string

    low, up, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    alphabets = {"hex": digits + "ABCDEF", "base32": up + "234567", "low32": low + "234567", "lower": low + digits, "base64": up + low + digits + "+/"}
    least = {20: 0.2, 32: 0.6, 40: 0.75, 64: 0.9}
    rng = random.Random(4)
    keys = [(name, n, "".join(rng.choices(a, k=n))) for name, a in alphabets.items() for n in least for _ in range(60)]
    words = "test value series index default handler abstract request parser module import label window format string array config session metadata quarter zone".split()
    joined = {"snake": "_".join, "path": "/".join, "plain": "".join, "camel": lambda w: "".join(map(str.title, w)), "upper": lambda w: "_".join(w).upper(), "numbered": lambda w: "".join(x + str(rng.randrange(30)) for x in w)}
    names = [j(rng.choices(words, k=rng.randrange(4, 9))) for j in joined.values() for _ in range(1_800)]
    names += ["550e8400-e29b-41d4-a716-446655440000", "abcdefghijklmnopqrstuvwxyz0123456789", "x1z9" * 8, "qwertyuiopasdfghjklzxcvbnm", "f" * 30, "20240131120000123456"]
    rows = list(enumerate([k for _, _, k in keys] + [w for w in names if len(w) >= 20]))
    hits = {r.doc_id for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if any(s.kind == "random" for s in r.secrets)}
    for name in alphabets:
        for n, share in least.items():
            mine = [i for i, k in enumerate(keys) if k[:2] == (name, n)]
            assert sum(i in hits for i in mine) >= share * len(mine), (name, n, sum(i in hits for i in mine))
    assert sum(i >= len(keys) for i in hits) <= 0.01 * len(hits), [rows[i] for i in hits if i >= len(keys)][:5]

def test_long_runs_and_many_matches(spark):
    import time

    rng = np.random.default_rng(13)
    run = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 1_000_000))
    many = " ".join(f"token={'%012x' % i}" for i in range(3_000))
    df = spark.createDataFrame([(1, f"data {run} end"), (2, many)], "doc_id long, text string")
    secrets.scan(df.where("doc_id < 0")).count()
    began = time.time()
    got = {r.doc_id: r.secrets for r in secrets.scan(df).collect()}
    assert time.time() - began < 30
    assert [(s.start, s.kind, s.stop) for s in got[1]] == [(5, "random", 1_000_005)]
    assert [(s.start, s.rank, s.kind, s.stop) for s in got[2] if s.rank < 3] == base_spans(many)


def test_copies_of_a_string_are_one_test(spark):
    """Repeating one candidate must not lower the cutoff for the others."""
    rng = np.random.default_rng(14)
    rows = [(int(20 + i % 60), int(c), int(i)) for i, c in enumerate(rng.integers(0, 90, 400))]
    schema = "n int, cell int, h long"
    assert secrets.cutoffs(spark.createDataFrame(rows, schema)) == secrets.cutoffs(spark.createDataFrame(rows + [rows[0]] * 500 + [max(rows, key=lambda r: r[1])] * 500, schema))


def test_query_of_secrets(spark, texts):
    """The whole table against Python's expressions: counts, places, and the digest."""
    for r in secrets.query(spark, SF).collect():
        want = base_spans(texts[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, _, k, _ in want) for kind in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest()
        shown = [x.split(":") for x in r.spans.split(",") if x]
        assert [x for x in shown if x[0] != "random"] == [[k, str(a), str(b)] for a, _, k, b in want]
        assert all(int(a) < int(b) <= len(texts[r.doc_id]) for _, a, b in shown)


# --- privacy ----------------------------------------------------------------------------------
def test_surrogates(spark, awkward, empty):
    rows = [(1, "Mail Bob.x-1@mail5.example.com or BOB.X-1@MAIL5.EXAMPLE.COM, call +1 (017) 555-7713; 4111 1111 1111 1111, 4111111111111111, 10.2.3.4."), (2, "Mrs. Anna Smith met Mr Smith and Herr Müller; Г-жа Анна Иванова."), (3, "Bob.x-1@mail5.example.com"), (4, None), (5, "12 plain words")]
    out = {r.doc_id: r for r in privacy.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    a = re.fullmatch(r"Mail (\S+) or (\S+), call (\+1 \(\d{3}\) \d{3}-\d{4}); (\d{4} \d{4} \d{4} \d{4}), (\d{16}), (\d+\.\d+\.\d+\.\d+)\.", out[1].text)
    assert a and a[1].lower() == a[2].lower() == out[3].text.lower() and a[1].endswith(".com")
    assert a[4].replace(" ", "") == a[5] and a[5] != "4111111111111111"
    digits = [int(x) for x in a[5]][::-1]
    assert sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(digits)) % 10 == 0
    b = re.fullmatch(r"Mrs\. (\w+a) (\w+) met Mr (\w+) and Herr (\w+); Г-жа ([а-яА-Я]+а) ([а-яА-Я]+)\.", out[2].text)
    assert b and b[2] == b[3] != b[4]
    for gone in ("Smith", "Anna", "Müller", "Иванова", "Bob", "555-7713"):
        assert gone not in out[2].text + out[1].text
    assert (out[4].text, out[5].text, out[5].pii) == (None, rows[4][1], 0)
    assert privacy.pseudonymised(awkward, "k").count() == awkward.count()
    assert privacy.pseudonymised(empty, "k").count() == 0


def test_formats_are_permuted(spark):
    """On a whole domain, surrogates are all of it, and none stays as it is."""
    texts = [f"{i:03d}" for i in range(1000)] + [f"{a}{i}" for a in "abcdefghijklmnopqrstuvwxyz" for i in range(10)] + list("0123456789")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.p for r in df.select("t", F.expr(privacy.of_text("t", "k", "'x'")).alias("p")).collect()}
    assert sorted(got.values()) == sorted(texts) and not any(a == b for a, b in got.items())
    other = {r.t: r.p for r in df.select("t", F.expr(privacy.of_text("t", "another", "'x'")).alias("p")).collect()}
    assert sum(got[t] == other[t] for t in texts) < 60


def test_names_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(privacy, "SYLLABLES", 1)  # 676 names at the first attempt
    rows = [("surname", "", f"x{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(600)] + [("given", "f", "anna"), ("given", "", "anna"), ("given", "m", "kim"), ("given", "f", "kim"), ("given", "", "kim")]
    made = privacy.names(spark.createDataFrame(rows, "kind string, gender string, norm string"), "k").collect()
    of = {(r.kind, r.gender, r.norm): r.made for r in made}
    assert len(of) == len(rows) and of["given", "f", "anna"] == of["given", "", "anna"]
    assert len({of["given", g, "kim"] for g in ("f", "m", "")}) == 3
    surnames = {m for (k, *_), m in of.items() if k == "surname"}
    assert len(surnames) == 600 and not surnames & {n for *_, n in rows}


def test_spellings_share_a_surrogate(spark):
    def luhn(t):
        return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(re.sub(r"\D", "", t))))) % 10

    pairs = [
        ("+49 30 1234567", "+49301234567"), ("(555) 555-1234", "+1 555.555.1234"), ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"),
        ("4111-1111-1111-1111", "4111111111111111"), ("Jo.Doe@Mail.example.org", "jo.doe@mail.example.org"), ("123-45-6789", "123-45-6789"), ("10.0.0.255", "10.0.0.255"),
    ]
    stay = ["1700000000000", "999.999.1.2", "4111 1111 1111 1112", "DE88 3704 0044 0532 0130 00"]
    rows = [(i, f"a {x} b") for i, x in enumerate([v for p in pairs for v in p] + stay)]
    out = [r.text[2:-2] for r in sorted(privacy.pseudonymised(spark.createDataFrame(rows, "id long, text string"), "k").collect(), key=lambda r: r.id)]
    plain = lambda t: re.sub(r"[^0-9a-z]", "", t.lower())
    for k, (a, b) in enumerate(pairs):
        x, y = out[2 * k], out[2 * k + 1]
        assert plain(x).endswith(plain(y)) or plain(y).endswith(plain(x)), (a, x, y)
        assert plain(x) != plain(a)
        assert a == "10.0.0.255" or re.sub(r"[0-9A-Za-z]", "", x) == re.sub(r"[0-9A-Za-z]", "", a)
    assert out[0].startswith("+49") and out[1].startswith("+49") and out[3].startswith("+1 ")
    assert luhn(out[6]) == luhn(out[7]) == 0 and out[6][0] == "4"
    number = "".join(str(int(c, 36)) for c in out[5][4:] + out[5][:4])
    assert out[5].startswith("DE") and int(number) % 97 == 1
    assert out[8].endswith(".org") and all(int(o) < 256 for o in out[12].split("."))
    assert out[14:] == stay


def test_further_mentions_and_titles(spark):
    rows = [(1, "Mrs Anna Smith left. Smith said so, and Anna too; SMITH, smithy."), (2, "Dr Anna Smith and Prof. Smith"), (3, "Anna Smith has no title here")]
    out = {r.id: r.text for r in privacy.pseudonymised(spark.createDataFrame(rows, "id long, text string"), "k").collect()}
    m = re.fullmatch(r"Mrs (\w+) (\w+) left\. (\w+) said so, and (\w+) too; (\w+), smithy\.", out[1])
    assert m and m[2] == m[3] and m[1] == m[4] and m[5] == m[2].upper() and m[2] != "Smith"
    assert out[2] == f"Dr {m[1]} {m[2]} and Prof. {m[2]}" and out[3] == rows[2][1]


# --- language ---------------------------------------------------------------------------------
def test_languages(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    out = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert out[0] >= 0.97 and out[1] > 100
    mixed = docs.where("lang in ('en', 'de') and n_chars > 3000").groupBy("lang").agg(F.min_by("text", "doc_id").alias("t")).orderBy("lang").collect()
    both = spark.createDataFrame([(1, mixed[0].t[:3000] + " " + mixed[1].t[:3000])], "doc_id long, text string")
    assert {x.split(":")[0] for x in language.predict(both, model).first().languages.split(",")} == {"de", "en"}
    got = {(r.doc_id, r.lang_pred) for r in language.predict(awkward, model).where("score = 0").collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "und")}
    assert language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(awkward, language.train(empty)).collect()} == {"und"}


def test_held_out_rows_are_not_learned(spark):
    rows = [(i, "aaa bbb" if zlib.crc32(str(i).encode()) % 5 else "xyz", "l1" if zlib.crc32(str(i).encode()) % 5 else "l2") for i in range(100)]
    assert language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[0] == ["l1"]


# --- sharding ---------------------------------------------------------------------------------
def test_lookup_table():
    shards = {f"s{i}": 1 for i in range(7)}
    t = sharding.lookup_table(shards, 1009)
    counts = [t.count(s) for s in shards]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table({k: 1 for k in shards if k != "s3"}, 1009)
    assert sum(a != b for a, b in zip(t, fewer) if a != "s3") < 0.2 * 1009
    heavy = sharding.lookup_table(shards | {"s0": 3}, 1009)
    assert heavy.count("s0") > 2 * heavy.count("s1")
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1000)


def test_assignment(spark, awkward, empty):
    shards = {f"s{i}": 1 for i in range(5)}
    t = sharding.lookup_table(shards, 1009)
    for r in sharding.assign(awkward, "doc_id", shards, 1009).collect():
        key = "␀" if r.doc_id is None else str(r.doc_id)
        assert r.shard == t[int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 1009]
    assert sharding.assign(empty, "doc_id", shards).count() == 0


# --- toxicity ---------------------------------------------------------------------------------
def test_ordinal_fit():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 3, (4_000, 4)).astype(float)
    u = x @ [2.0, -1.0, 0.5, 0.0] + rng.logistic(size=4_000)
    y = (u > 1).astype(int) + (u > 3)
    row, col = np.nonzero(x)
    w, cuts = toxicity.fit(row, col, x[row, col], 4, y, 3, ridge=0.01, steps=1_500)
    assert np.allclose(w, [2, -1, 0.5, 0], atol=0.25) and np.allclose(cuts, [1, 3], atol=0.35) and cuts[0] < cuts[1]


def test_toxic_documents_are_found(spark, awkward, empty):
    rng = np.random.default_rng(10)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [f"w{x}" for x in rng.integers(0, 400, 60)]
        if bad:
            w[10:10] = ["vilestem" + "".join(rng.choice(list("abcde"), 3)), "rude"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 12 != 0), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    graded = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, toxicity._grades(graded))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].toxic == (i % 6 == 0) for i in got)
    assert model["grades"] == [0, 1, 2] and got[0].expected_severity > 1
    assert {r.doc_id for r in toxicity.kept(docs, graded).collect()} == {i for i in range(600) if i % 6}
    assert toxicity.score(awkward, model).where("toxic").count() == 0
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(awkward, toxicity.train(awkward, toxicity._grades(graded.limit(0)))).where("expected_severity <> 0").count() == 0


# --- pipeline ---------------------------------------------------------------------------------
def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns, name
        kept = spark.createDataFrame(after.collect(), docs.schema)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert len({v[1] for v in brute_components(texts, 5, 80, 100).values()}) == len(texts)
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()} == set(ids)
