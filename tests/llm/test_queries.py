"""Each query of the training-data operators over a whole table, against a plain version of it,
and the operators on tables that already have the columns they make or use."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm")
import duckdb  # noqa: E402
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quillspark.llm import common, decontamination, graph, language, packing, privacy, queries, quality, secrets, sharding, token_files, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


def ids_of(file, text):
    return Tokenizer.from_file(file).encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, rows):
    got: dict[int, list] = {}
    places: dict[int, list] = {}
    for r in queries.queries()["op2_packing"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got.keys() == rows.keys()
    whole = Tokenizer.from_file(BYTE)
    for doc, mine in got.items():
        ids = whole.encode(rows[doc].text or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, r in enumerate(sorted(mine, key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length])) and (k == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids) and len(mine) == -(-len(ids) // 1024)
    for mine in places.values():
        at = 0
        for offset, length in sorted(mine):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(length for mine in places.values() for _, length in mine)
    assert len(places) <= math.ceil(total / 1024) * 1.02 + 1


def test_token_files(spark, rows):
    start = 0
    got = {r.doc_id: r for r in queries.queries()["op8_token_files"](spark, SF).collect()}
    whole = Tokenizer.from_file(WORD)
    for doc in sorted(rows):
        ids = whole.encode(rows[doc].text or "", add_special_tokens=False).ids + [2]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_parts_are_read_by_batches(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/t"
    parts = token_files.write(docs, folder, WORD, sequence=64, rows=8)
    assert token_files.listed(folder) == parts
    for file, _, n in parts:
        f = token_files.TokenFile(file)
        whole = np.concatenate([f.sequence(i) for i in range(-(-n // 64))]) if n else []
        for start in range(0, n, max(1, n // 7)):
            assert np.array_equal(f.ids(start, min(3_000, n - start)), whole[start : min(start + 3_000, n)])
        assert len(f._held) <= token_files.HELD
        f.close()
    assert token_files._fs(f"file://{tmp_path}")[0].type_name == "local"


def test_sharding(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(sharding.SQL).fetchall()
    assert sorted(map(tuple, queries.queries()["op9_sharding"](spark, SF).collect())) == sorted(want)
    null = spark.createDataFrame([(None,)], "doc_id long")
    at = int(hashlib.md5("␀".encode()).hexdigest()[:15], 16) % 1009
    assert sharding.assign(null, "doc_id", {"a": 1, "b": 2}, 1009).first().shard == sharding.lookup_table({"a": 1, "b": 2}, 1009)[at]


def test_decontamination(spark, rows):
    """All items against all stretches of all documents, without seeds."""
    items = {r.item_id: decontamination.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    number: dict[str, int] = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
    encoded = {i: code(ws) for i, ws in items.items()}
    known = {w for ws in items.values() for w in ws}
    want = set()
    for doc, r in rows.items():
        ws = decontamination.words_of(r.text)
        text = code(ws)
        for i, item in encoded.items():
            # a score of 0.4 needs 0.4 of the item's words at least
            if len(item) >= decontamination.WORDS and sum(w in known for w in ws) and np.isin(item, text).sum() >= 0.4 * len(item) and decontamination.smith_waterman(item, text)[0] >= decontamination.SCORE * decontamination.MATCH * len(item):
                want.add((doc, i))
    got = {(r.doc_id, r.item_id) for r in queries.queries()["op5_decontamination"](spark, SF).collect()}
    assert got <= want
    assert len(got) >= 0.9 * len(want), sorted(want - got)[:5]


def test_privacy(spark, rows):
    """Every value of a format outside of the changed ones is as it was, and a value has one surrogate."""
    spark.conf.set("spark.quillspark.pii.key", "a key of the tests")
    try:
        out = {r.doc_id: r for r in queries.queries()["op4_privacy"](spark, SF).collect()}
    finally:
        spark.conf.unset("spark.quillspark.pii.key")
    assert out.keys() == rows.keys()
    seen: dict[tuple[str, str], str] = {}
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}"}
    for doc, r in rows.items():
        before, after = r.text or "", out[doc].text or ""
        if not out[doc].pii:
            assert before == after
        for kind, p in rx.items():
            a, b = re.findall(p, before), re.findall(p, after)
            assert len(a) == len(b)
            for x, y in zip(a, b):
                assert x.lower() != y.lower() and seen.setdefault((kind, x.lower()), y.lower()) == y.lower()
    assert len(set(seen.values())) == len(seen) > 3


def test_language(spark, rows):
    """The mixtures, by an EM over Python's dictionaries and all subsets in the order of the proportions."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    names, p = language.train(frame)

    def em(cells, chosen):
        share = {k: 1 / len(chosen) for k in chosen}
        mixed = lambda c: sum(share[k] * p[c, k] for k in chosen)
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(chosen, 0.0)
            for c, n in cells:
                m = mixed(c)
                for k in chosen:
                    new[k] += n * share[k] * p[c, k] / m
            share = {k: v / sum(new.values()) for k, v in new.items()}
        return share, sum(n * math.log(mixed(c)) for c, n in cells)

    got = {r.doc_id: r for r in queries.queries()["op7_language"](spark, SF).collect()}
    assert got.keys() == rows.keys()
    short = sorted(rows, key=lambda d: len(rows[d].text or ""))[:40]
    for doc in short:
        r = got[doc]
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 5 == 0)
        at, n = language.cells(rows[doc].text)
        if not len(at):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cells = list(zip(at.tolist(), n.tolist()))
        every = range(len(names))
        alone = max(every, key=lambda k: sum(m * math.log(p[c, k]) for c, m in cells))
        cost = language.PENALTY * 0.5 * math.log(sum(n) + 1)
        best, value = ({alone: 1.0}), sum(m * math.log(p[c, alone]) for c, m in cells) / language.OVERLAP - cost
        full, _ = em(cells, every)
        order = sorted(every, key=lambda k: -full[k])
        for k in range(2, len(names) + 1):
            share, like = em(cells, order[:k])
            if like / language.OVERLAP - k * cost > value + 1e-9:
                best, value = share, like / language.OVERLAP - k * cost
        top = max(best, key=best.get)
        assert (r.lang_pred, r.score) == (names[top], pytest.approx(best[top], abs=1e-6))


def test_toxicity(spark, rows):
    """The severities, from the fitted weights by a plain sum over words and their beginnings."""
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.train(frame, toxicity._grades(spark.read.parquet("/root/testdata/sf0.01/labels.parquet")))
    assert model and model["cuts"] == sorted(model["cuts"])
    weight = dict(zip(model["words"], model["weights"]))
    for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect():
        counts: dict[str, int] = {}
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            for f in [w, *(w[:k] + "-" for k in range(3, 8) if k <= len(w))]:
                if f in weight:
                    counts[f] = counts.get(f, 0) + 1
        u = sum(weight[f] * math.log1p(n) for f, n in counts.items())
        above = [1 / (1 + math.exp(c - u)) for c in model["cuts"]]
        assert r.expected_severity == pytest.approx(sum(s * x for s, x in zip(np.diff(model["grades"]), above)), abs=1e-9)
        assert r.toxic == (above[0] >= toxicity.TOXIC)


def test_too_many_languages_are_an_error(spark):
    rows = [(i, "some text", f"l{i}") for i in range(60)]
    with pytest.raises(ValueError):
        language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=5)


def test_hubs_are_split(spark):
    """A star and a set of chains, with the hub's edges as most of all."""
    edges = [(0, i) for i in range(1, 400)] + [(1_000 + 2 * i, 1_001 + 2 * i) for i in range(50)] + [(399, 5_000), (5_000, 4_000)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(400), 5_000, 4_000]) and all(got[1_001 + 2 * i] == 1_000 + 2 * i for i in range(50))
    rows = spark.createDataFrame([(k % 3 and k, k) for k in range(300)], "u long, x long")
    facts = rows.groupBy("u").agg(F.count("*").alias("n"), F.max("x").alias("m"))
    for heavy in (1, 10, 10**6):
        joined = common.split_join(rows, facts, "u", 300, heavy)
        assert sorted(map(tuple, joined.select("u", "x", "m").collect())) == sorted(map(tuple, rows.join(facts, "u").select("u", "x", "m").collect()))


#: Names of columns that operators make or use inside, and some that differ in case only.
CLASHES = ["leaked", "copy", "slot", "name", "assign", "access", "hex", "random", "runs", "whole", "old", "spans", "given", "secrets", "pii", "row", "fakes", "made", "bucket", "rank", "before", "n", "share", "size", "shard", "toxic", "P_TOXIC", "expected_severity", "family", "stratum", "cluster", "rep", "item", "items", "node", "component", "Length", "_text", "_slot", "_rank"]


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i, t, *(f"{c}-{i}" for c in CLASHES)) for i, t in enumerate(["one two three", None, "", "token = 'abcdefgh12' and Mrs Anna Smith", "one two three"])]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))




def kept_columns(before, after, replaced=()):
    """All columns but the replaced ones have the values they had."""
    want = {r.doc_id: r for r in before.collect()}
    got = after.collect()
    for r in got:
        for c in CLASHES:
            if c not in replaced:
                assert r[c] == want[r.doc_id][c], c
    return {r.doc_id for r in got}


@pytest.mark.parametrize("name", ["decontamination", "secrets", "redact", "privacy", "sharding", "toxicity", "scores", "copies"])
def test_clashing_names(name, spark, crowded):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
    every = set(range(5))
    if name == "decontamination":
        assert kept_columns(crowded, decontamination.clean(crowded, bench)) == {1, 2, 3}
    elif name == "secrets":
        assert kept_columns(crowded, secrets.scan(crowded), ["secrets"]) == every
    elif name == "redact":
        assert kept_columns(crowded, secrets.redact(crowded)) == every
    elif name == "privacy":
        out = privacy.pseudonymised(crowded, "k")
        assert kept_columns(crowded, out, ["pii"]) == every and "Smith" not in out.where("doc_id = 3").first().text
    elif name == "sharding":
        assert kept_columns(crowded, sharding.assign(crowded, "doc_id", {"a": 1}, 101), ["shard"]) == every
    elif name == "toxicity":
        out = toxicity.kept(crowded, labels)
        assert out.columns == crowded.columns and kept_columns(crowded, out) <= every
    elif name == "scores":
        assert kept_columns(crowded, toxicity.score(crowded, None), ["toxic", "P_TOXIC", "expected_severity"]) == every
    else:
        pipeline = pytest.importorskip("corpus_pipeline")
        out = pipeline.distinct_texts(spark, crowded, SF)
        assert out.columns == crowded.columns and kept_columns(crowded, out) == {0, 1, 2, 3}


def test_clashing_names_in_packing(spark):
    found = spark.createDataFrame([(1, 0, 0, 5, 7, "x", "y", "z"), (2, 0, 0, 9, 8, "x", "y", "z")], "doc_id long, piece int, start long, length long, ids_crc32 long, bucket string, rank string, size string")
    out = packing.pack(found, 16).collect()
    assert [(r.bucket, r.rank, r.size) for r in out] == [("x", "y", "z")] * 2 and {r.sequence_id for r in out} == {0}


def test_quality_and_language_read_three_columns(spark, crowded):
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")
    more = crowded.withColumn("lang", F.lit(None).cast("string"))
    assert quality.judged(more, labels).count() == 5
    assert language.predict(more.select("doc_id", "text", "lang"), language.train(more)).count() == 5
