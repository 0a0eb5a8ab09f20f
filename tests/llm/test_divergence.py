"""The source divergence audit against SQL, a plain count and awkward rows."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("quillspark.llm")
from quillspark.llm import divergence  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, part string, rank int, n long"


def plain(rows):
    """Every group and pair over all kept terms, densely."""
    uses, docs_of, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        found = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")
        found = [w for w in found if w]
        uses[lang, source].update(found)
        docs_of[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in docs_of[lang].items() if n >= 3), key=lambda t: t.encode())
        sources = [s for g, s in groups if g == lang]
        total = {s: sum(uses[lang, s][t] for t in kept) for s in sources}

        def shares(count, n):
            return [1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept]

        whole = sum((uses[lang, s] for s in sources), Counter())
        q = shares(whole, sum(total.values()))
        p = {s: shares(uses[lang, s], total[s]) for s in sources}
        for s in sources:
            values = sorted(((-sum((x - y) ** 2 // y for x, y in zip(p[s], p[o])), o) for o in sources if o != s), key=lambda v: (v[0], v[1].encode()))
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(values)}
            values = sorted((-((x - y) ** 2 // y), t.encode()) for x, y, t in zip(p[s], q, kept) if uses[lang, s][t] and x > y)
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(values[:200])}
    return out


def found(df):
    rows = [(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


#: A smaller sketch, in which terms collide.
SMALL = 1 << 10


def test_query_as_sql_and_as_a_plain_count(spark):
    got = found(divergence.query(spark, SF))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(divergence.SQL)
    assert [c[0] for c in cur.description] == ["lang", "source", "part", "item", "value", "rank"]
    assert got == set(cur.fetchall())
    assert got == plain(spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_awkward_rows(spark):
    long = " ".join(f"W{i * 7919 % 500}x ß{i % 50}" for i in range(60_000))
    rows = [("Ab ab\x00AB éÉ İ", "en", "a"), ("ab x", "en", "b"), ("ab-ab", None, "a"), ("ab", "", None), ("ab", None, None), (None, "en", "c"), ("", "en", "c"), ("1 2 3", "xx", "only"), ("1 2 3", "xx", "other")]
    rows += [("ab cd", "en", "b")] * 3 + [(long, "en", "long"), (long, "en", "long"), (long, "en", "b")]
    df = spark.createDataFrame([(1, t, lang, s, "p", 1, 2) for t, lang, s in rows], SCHEMA)
    got = found(divergence.audit(df, width=SMALL))
    assert got == plain(df.collect())
    assert ("xx", "only", "pair", "other", 0, 1) in got and {g[1] for g in got if g[0] == "en"} >= {"a", "b", "c", "long"}
    assert found(divergence.audit(df.repartition(7), width=SMALL)) == got


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA), width=SMALL).collect() == []


def test_sketch_is_never_below():
    rng = np.random.default_rng(3)
    words = [f"w{i}".encode() for i in range(3_000)]
    count = rng.integers(1, 400, len(words))
    sketch = divergence.Sketch(1 << 11)
    hashes = divergence.Sketch.hashes(b"en", words)
    for some in np.array_split(np.arange(len(words)), 5):
        sketch.add(hashes[some], count[some])
    got = sketch.estimate(hashes)
    assert (got >= np.minimum(count, 255)).all() and (got == np.minimum(count, 255)).any()


def test_sketch_discards_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, f"common once{chr(97 + i // 26)}{chr(97 + i % 26)}", "en", "a", "p", 1, 2) for i in range(600)], SCHEMA)
    counters = divergence.Sketch(divergence.WIDTH, divergence.frequencies(df))
    words = [f"once{chr(97 + i // 26)}{chr(97 + i % 26)}".encode() for i in range(600)]
    estimates = counters.estimate(divergence.Sketch.hashes(b"en", words))
    assert (estimates >= 1).all() and (estimates < divergence.LEAST).all()
    assert counters.estimate(divergence.Sketch.hashes(b"en", [b"common"]))[0] == 255


def test_shares_are_exact_beyond_longs(spark):
    n, total, v = 3 * 10**12, 10**13 + 7, 12_345
    got = spark.sql(f"SELECT {n} AS n, {total} AS total, {v} AS v").select(divergence.share("n", "total", "v").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 1) // (total + v)
