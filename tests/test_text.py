"""Literal examples of the text, label and extraction functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import extraction as ex
from quillspark.operators import models as md
from quillspark.operators import tables as tb
from quillspark.plans import catalogue


def value(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_normalise_keeps_two_blanks(spark):
    assert value(spark, tx.normalize_text(F.col("t")), t=" A -  b.") == "a  b"


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(tx.normalize_text(F.col("t")), F.size(tx.candidate_names(F.col("t")))).first()[0] is None


@pytest.mark.parametrize(("text", "hit"), [("endophytes are ubiquitous here", 1.0), ("endophytes are ubiquitus here", 0.96), ("fungi are rare here", None)])
def test_fuzzy_phrase(spark, text, hit):
    got = ex.statements(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", {"all": ["endophytes are ubiquitous"]}).collect()
    assert [r.similarity for r in got] == ([] if hit is None else [hit])


@pytest.mark.parametrize(("a", "m", "n", "level"), [(8, 4, 2, "Very High"), (8, 4, 1, "High"), (6, 3, 1, "High"), (3, 2, 1, "Medium"), (1, 1, 1, "Low"), (0, 9, 0, "None")])
def test_evidence_level(spark, a, m, n, level):
    assert spark.range(1).select(ex.evidence_level(F.lit(a), F.lit(m), F.lit(n))).first()[0] == level


@pytest.mark.parametrize(("sp", "sa", "gp", "ga", "p", "a", "label"), [(0.7, 0.3, 0.2, 0.8, 0.5, 0.7, "Absence"), (0.9, 0.1, 0.6, 0.4, 0.78, 0.34, "Presence")])
def test_ensemble(spark, sp, sa, gp, ga, p, a, label):
    got = spark.range(1).select(md.ensemble_weighted(*map(F.lit, (sp, sa, gp, ga)))).first()[0]
    assert (got.presence, got.absence, got.label) == (p, a, label)


def test_years_and_bins(spark):
    df = spark.createDataFrame([(1985, 0.5), (1980, 0.0)], "y int, c double").select(md.period_right_closed(F.col("y")), md.right_closed(F.col("c"), 0.1), md.period(F.col("y")))
    assert [tuple(r) for r in df.collect()] == [("1980-1984", "0.4-0.5", 1985), (None, None, 1980)]


def test_ties_are_kept(spark):
    df = spark.createDataFrame([(n,) for n in (9, 8, 7, 6, 5, 5)], "n int")
    assert tb.top_with_ties(df, "n", 5).count() == 6


def test_duplicates(spark):
    rows = [(1, "x", 1, "Same."), (2, "x", 0, "other"), (3, None, 2, "same"), (4, "", 2, None), (5, None, 2, None)]
    df = spark.createDataFrame(rows, "id long, doi string, rank int, text string")
    assert sorted(r.id for r in tb.first_by_keyed(df, "doi", ["rank", "id"]).collect()) == [2, 3, 4, 5]
    assert sorted(r.id for r in tb.first_by_text(df, "text", ["rank", "id"]).collect()) == [1, 2, 4, 5]


@pytest.fixture(scope="module")
def taxonomy(spark):
    rows = [(1, "Quercus robur", "accepted", None, "Plantae", "T", "Fagaceae", "Quercus"), (2, "Fagus sylvatica", "accepted", None, "Plantae", "T", "Fagaceae", "Fagus"), (3, "Quercus pedunculata", "synonym", 1, "Plantae", "T", "Fagaceae", "Quercus")]
    return spark.createDataFrame(rows, "taxonID long, canonicalName string, taxonomicStatus string, acceptedNameUsageID long, kingdom string, phylum string, family string, genus string")


def test_taxa(spark, taxonomy):
    docs = spark.createDataFrame([(1, "Quercus robur and Fagus  sylvatica are common trees."), (2, "quercus pedunculata"), (3, ""), (4, None), (5, "Quercuss robur")], "id long, t string")
    got = ex.taxa(docs, "id", "t", ex.lookups(taxonomy)).collect()
    assert {(r.id, r.match_type, r.resolved_name, r.status) for r in got} == {
        (1, "species", "Quercus robur", "ACCEPTED"), (1, "species", "Fagus sylvatica", "ACCEPTED"), (1, "genus", "Quercus", "ACCEPTED"), (1, "genus", "Fagus", "ACCEPTED"),
        (2, "species", "Quercus robur", "SYNONYM"), (2, "genus", "Quercus", "ACCEPTED"),
        (3, "none", None, "NO_MATCH"), (4, "none", None, "NO_MATCH"), (5, "none", None, "NO_MATCH"),
    }


def test_abbreviations(spark, taxonomy):
    names = spark.createDataFrame([("Q. robur",), ("X. robur",)], "n string")
    assert [r.canonicalName for r in ex.expanded_abbreviations(names, "n", taxonomy).collect()] == ["Quercus robur"]


def test_places(spark):
    texts = ["Niger is located in West Africa", "Aspergillus niger fungal growth", "Turkey tail fungus identification", "Iranian nuclear program discussions", "Studies from Guatemala, Honduras, and El Salvador", "at 45.5231 N, 12.3 E in Chile"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    rules = [ex.PlaceRule("Niger", needs="africa|niamey|country", not_with="aspergillus|fung"), ex.PlaceRule("Turkey", not_with="tail|fung")]
    countries = dict.fromkeys(["Niger", "Turkey", "Iran", "Guatemala", "Honduras", "El Salvador", "Chile"], "")
    out = ex.places(docs, "t", countries, rules, {}, {"Iranian": "Iran"}, ["Africa"], ["West Africa"], {"Chile"}).orderBy("id").collect()
    assert [r.countries_detected for r in out] == ["Niger", "", "", "Iran", "El Salvador; Guatemala; Honduras", "Chile"]
    assert [r.has_coordinates for r in out] == [False] * 5 + [True]
    assert out[0].geographic_summary == "Niger; Africa; West Africa"


def test_parts(spark):
    docs = spark.createDataFrame([(1, "root systems, roots and root hairs; leaves, leaf and stems"), (2, None)], "id long, t string")
    out = ex.parts(docs, "t", ["root", "roots", "leaf", "leaves", "stem", "stems"], ["root hair"], {"leaves": "leaf"}).orderBy("id").collect()
    assert out[0].parts_normalized == "root; leaf; stem; root hair"
    assert (out[1].parts_count, out[1].plant_parts_detected) == (0, "")


def test_guilds(spark):
    rows = [("Ectomycorrhizal", True), ("Plant Pathogen", False), ("Orchid Mycorrhizal-Saprotroph", True), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "g string, want boolean")
    assert df.where(ex.is_mycorrhizal(F.col("g")) != F.col("want")).count() == 0


def test_trait_cascade(spark):
    names = spark.createDataFrame([("Glomus one",), ("Russula two",), ("Russula three",), ("Mucor four",)], "resolved_name string")
    traits = spark.createDataFrame([("Glomus_one", "higher_clade", "Glomeromycota"), ("Russula_two", "guild_fg", "Ectomycorrhizal")], "species string, trait_name string, value string")
    got = {r.resolved_name: (r.is_mycorrhizal, r.confidence) for r in ex.classified(names, traits).collect()}
    assert got == {"Glomus one": (True, 0.95), "Russula two": (True, 0.9), "Russula three": (True, 0.7), "Mucor four": (False, 0.1)}


def test_context(spark):
    text = "one two three of the four five"
    assert value(spark, tx.context_words(F.col("t"), "of the", 1), t=text) == "three of the four"
    assert value(spark, tx.context_words(F.col("t"), "not there"), t=text) is None


def test_bigrams_by_corpus_count(spark):
    docs = spark.createDataFrame([(1, "red oak and red oak"), (2, "The red oak"), (3, "old elm, 2 elms"), (4, "old elm"), (5, "single words"), (6, None)], "id long, t string")
    got = {tuple(r) for r in ex.bigram_counts(docs, "id", "t", ["the", "and"]).collect()}
    assert got == {(1, "red_oak", 2), (2, "red_oak", 1), (3, "old_elm", 1), (4, "old_elm", 1), (5, None, 0), (6, None, 0)}


def test_halves_and_ties(spark, tmp_path):
    lines = [(1, 1, 0.50, 0.01), (1, 7, 12.50, 0.05), (2, 3, 100.10, 0.05), (2, 4, 3.33, 0.10)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.l_orderkey, r.l_linenumber): r.x for r in catalogue.queries()["MTH1"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): 0.01, (1, 7): 0.63, (2, 3): 5.01, (2, 4): 0.33}
    labels = [(i, 0, 1) for i in range(101)]  # both confidences take each of 0.00 to 1.00
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = {r.id: r for r in catalogue.queries()["ML16"](spark, str(tmp_path)).collect()}
    assert len(rows) == 101
    for i, r in rows.items():
        for p, yes, no, kind in ((i * 37 % 101, "Relevant", "Irrelevant", "relevance"), (i * 53 % 101, "Presence", "Absence", "pa")):
            for level, t in (("loose", 50), ("medium", 60), ("strict", 80), ("super_strict", 90))[: 3 if kind == "relevance" else 4]:
                assert r[f"{kind}_{level}"] == (yes if p >= t else no if 100 - p >= t else "Uncertain")


def test_nearest_names(spark):
    for a, b, want in (("MARTHA", "MARHTA", 0.961111), ("DWAYNE", "DUANE", 0.84), ("DIXON", "DICKSONX", 0.813333), ("abc", "xyz", 0), ("", "", 1), ("a", "", 0), ("a", "a", 1)):
        assert round(tx.jaro_winkler(a, b), 6) == want
    names = spark.createDataFrame([(1, "quercus robor"), (2, "fagus silvatica"), (3, "zzz"), (4, None), (5, "quercus")], "k long, n string")
    known = spark.createDataFrame([(0, "fagus sylvatica"), (1, "quercus robur"), (2, "quercus rubra"), (3, "quercus robur")], "i int, c string")
    got = {r.k: r for r in ex.nearest_names(names, "k", "n", known, "c", "i").collect()}
    assert {k: r.nearest for k, r in got.items()} == {1: "quercus robur", 2: "fagus sylvatica", 3: None, 4: None, 5: "quercus robur"}
    assert got[3].distance == 1 and got[4].distance is None and 0 < got[1].distance < 0.05


def test_coordinates(spark):
    yes = ["45.5°N, 122.3°W", "45.5, -122.3", "45°30'45\"N, 122°45'30\"W", "45.5N, 122.3W", "45N, 122W", "45 30 N, 122 45 W", "(45.5, -122.3)", "45°30′N 122°45′W", "45N 123456 7890123", "45N123456", "40-50°N, 120-130°W", "N45.5, W122.3", "[45.5, -122.3]"]
    yes += ["45.5°N 122.3°W 1500m", "SU 0012 5678", "1234N123456E 10, 20", "00000012NE", "500.25, 400 plots, then 45N, 122W", "SU 1234 5678; (12, 99)"]
    no = [None, "", "no numbers", "12 plots in 1999", "45.5 N alone", "SU-1234-5678", "1234N123456E", "about 45N"]
    df = spark.createDataFrame([(t, t in yes) for t in yes + no], "t string, want boolean")
    assert [r.t for r in df.where(ex.has_coordinates(F.col("t")) != F.col("want")).collect()] == []


def test_quotas():
    assert tb.proportional_quotas({"a": 90, "b": 9, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert sum(tb.balanced_quotas(["a", "b", "c"], 10).values()) == 10


def test_many_to_one_is_checked(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="more than once"):
        tb.left_many_to_one(left, right, ["k"]).collect()


def test_context_of_a_long_text(spark):
    import time

    text = " ".join(f"w{i % 977}" for i in range(20_000)) + " of the end"
    df = spark.createDataFrame([(1, text), (2, None), (3, "of the"), (4, "")], "id long, t string")
    began = time.time()
    got = {r.id: r.c for r in df.select("id", tx.context_words(F.col("t"), "of the").alias("c")).collect()}
    assert got[1].endswith("of the end") and len(got[1].split()) == 18
    assert (got[2], got[3], got[4]) == (None, "of the", None)
    assert df.select(F.explode(tx.ngrams(tx.words(F.col("t")), 2))).count() == 20_002 + 1
    assert time.time() - began < 20


def test_fixed_places_are_those_of_the_binary_value(spark):
    import random

    rng = random.Random(2)
    values = [0.25, 0.35, 0.05, 0.15, 1.005, 2.675, 0.5, 1.5, 2.5, -0.25, -0.35, 99.95, 1e6 + 0.05, 0.0, *(rng.randrange(-200_000, 200_000) / 100 for _ in range(3_000)), *(rng.randrange(10**7) / 1_000 + 0.0005 for _ in range(1_000))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", *[tx.fixed(F.col("v"), k).alias(f"f{k}") for k in (0, 1, 2, 3)]).collect():
        assert [r.f0, r.f1, r.f2, r.f3] == [f"{r.v:.{k}f}" for k in (0, 1, 2, 3)], r.v


def test_first_by_digest(spark):
    rows = [(3, "a", None), (1, "a", 5), (2, None, 1), (4, None, 0), (5, "", 2)]
    df = spark.createDataFrame(rows, "id long, t string, x int")
    assert sorted(tuple(r) for r in tb.first_by(df, ["t"], ["id"], [tb.digest("t")]).collect()) == [(1, "a", 5), (2, None, 1), (5, "", 2)]
    assert sorted(r.id for r in tb.without_duplicated(df, ["t"]).collect()) == [5]
