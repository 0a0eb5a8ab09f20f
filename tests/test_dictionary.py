"""Dictionaries in texts and Bloom filters, against sets of names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import bloom as bl
from quillspark.operators import dictionary as dc
from quillspark.operators import extraction as ex

LETTERS = "abcdefghijklmnopqrst"


def made(rng, n):
    return sorted({" ".join("".join(rng.choices(LETTERS, k=rng.randint(2, 5))) for _ in range(rng.randint(1, 2))) for _ in range(n)})


@pytest.fixture(scope="module")
def many(spark):
    names = made(random.Random(1), 140_000)
    assert len(names) > 100_000
    return names, spark.createDataFrame([(n,) for n in names], "name string").repartition(4).cache()


def test_a_hundred_thousand_names(spark, many):
    names, df = many
    rng, known = random.Random(2), set(names)
    texts = {i: " ".join(rng.choices(names, k=30) + ["".join(rng.choices(LETTERS, k=4)) for _ in range(30)]) for i in range(200)}
    want = {}
    for i, text in texts.items():
        t = text.split(" ")
        for g in [*t, *(f"{a} {b}" for a, b in zip(t, t[1:]))]:
            if g in known:
                want[i, g] = want.get((i, g), 0) + 1
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    one, several = dc.dictionary(df, "name"), dc.dictionary(df, "name", part=300_000)
    assert len(one.parts) == 1 and one.names == len(names) and len(several.parts) > 1
    assert max(len(p.value) for p in several.parts) < 1_000_000  # parts are even
    for found in (one, several):
        got = {(r.id, r["name"]): r.n for r in dc.pairs(docs, dc.spaced(F.col("text")), found).collect()}
        assert got == want
    with pytest.raises(ValueError):
        dc.with_names(docs, F.col("text"), several)


def test_memory_of_an_automaton():
    names = made(random.Random(3), 20_000)
    size = dc.automaton(names, True).get_stats()["total_size"]
    assert size < 140 * sum(len(n) + 2 for n in names)


def test_awkward_texts_and_names(spark):
    names = spark.createDataFrame([(None,), ("",), ("ab",), ("ab",), ("ab ab",), ("ab ab ab",), ("b a",)], "name string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "ab ab ab ab"), (3, "ab ab ab ab"), (4, "Ab, AB! xab abx"), (5, "ab " * 300_000)], "id long, text string")
    got = sorted((r.id, r["name"], r.n) for r in dc.pairs(docs, dc.spaced(F.col("text")), dc.dictionary(names, "name")).collect())
    assert got == [(3, "ab", 4), (3, "ab", 4), (3, "ab ab", 3), (3, "ab ab", 3), (3, "ab ab ab", 2), (3, "ab ab ab", 2), (4, "ab", 2), (4, "ab ab", 1), (5, "ab", 300_000), (5, "ab ab", 299_999), (5, "ab ab ab", 299_998)]
    anywhere = dc.dictionary(names, "name", whole=False)
    assert sorted(r.id for r in dc.with_any(docs, F.col("text"), anywhere).collect()) == [3, 3, 4, 5]
    assert dc.with_any(docs, F.col("text"), dc.dictionary(names.limit(0), "name")).collect() == []
    clash = dc.with_names(docs.withColumn("Names", F.lit("x")), F.col("text"), anywhere)
    assert clash.columns == ["id", "text", "names"] and clash.count() == docs.count()


def test_taxa_with_long_texts(spark):
    rows = [(1, "Abies alba", "accepted", None, "Plantae", "P", "Pinaceae", "Abies"), (2, "Abies excelsa", "synonym", 1, "Plantae", "P", "Pinaceae", "Abies")]
    taxonomy = spark.createDataFrame(rows, "taxonID long, canonicalName string, taxonomicStatus string, acceptedNameUsageID long, kingdom string, phylum string, family string, genus string")
    docs = spark.createDataFrame([(1, "The Abies excelsa."), (2, "abies alba " + "x " * 60), (3, "nothing"), (4, None)], "id long, text string")
    got = sorted((r.id, r.match_type, r.resolved_name or "", r.status) for r in ex.taxa(docs, "id", "text", ex.lookups(taxonomy), max_tokens=50).collect())
    assert got == [(1, "genus", "Abies", "ACCEPTED"), (1, "species", "Abies alba", "SYNONYM"), (2, "genus", "Abies", "ACCEPTED"), (3, "none", "", "NO_MATCH"), (4, "none", "", "NO_MATCH")]


def test_bloom_loses_no_name_and_passes_few_others(spark, many, tmp_path):
    names, df = many
    of = bl.shape(len(names), 0.01)
    half = df.withColumn("domain", F.lit("d"))
    filters = bl.merged(bl.built(half.where("name < 'k'"), "name", "domain", of), bl.built(half.where("name >= 'k'"), "name", "domain", of))
    path = f"file://{tmp_path}/bloom"
    bl.save(filters, of, path)
    filters, again = bl.load(spark, path)
    assert again == of
    assert bl.probed(half, "name", "domain", filters, of).count() == len(names)
    others = spark.range(100_000).select(F.concat(F.lit("other "), "id").alias("name"), F.lit("d").alias("domain"))
    share = bl.probed(others, "name", "domain", filters, of).count() / 100_000
    assert 0.003 < share < 0.02
    exact = df.where("name < 'c'").select("name", F.lit("d").alias("domain"), F.length("name").alias("n"))
    assert bl.validated(others.union(half.select("name", "domain")), "name", "domain", filters, of, exact).count() == exact.count()


def test_bloom_by_domain_nulls_and_empty_tables(spark, tmp_path):
    of = bl.shape(10)
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "x"), ("c", None)], "name string, domain string")
    filters = bl.built(df, "name", "domain", of)
    asked = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), (None, "x"), ("a", "z"), ("a", None)], "name string, domain string")
    got = {tuple(r) for r in bl.probed(asked, "name", "domain", filters, of).collect()}
    assert got >= {("a", "x"), ("b", "y")} and (None, "x") not in got and ("a", "z") not in got
    empty = bl.built(df.limit(0), "name", "domain", of)
    assert bl.probed(asked, "name", "domain", empty, of).collect() == []
    bl.save(empty, of, f"file://{tmp_path}/none")
    assert bl.load(spark, f"file://{tmp_path}/none")[1] is None
    crowd = spark.range(40).select(F.lit("a").alias("name"), F.col("id").cast("string").alias("domain"))
    with pytest.raises(ValueError):
        bl.arrays(bl.built(crowd, "name", "domain", of), of)
