"""Reference lists, stages, writers, second pass and model operators on literal examples."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillspark import workflow as wf
from quillspark.operators import extraction as ex
from quillspark.operators import tables as tb
from quillspark.operators import training as tr
from quillspark.sources import files as fl
from quillspark.sources import reference as rf


def test_reference_lists(spark, tmp_path):
    lists = {
        "countries": "name,hemisphere\nMali,South\nNorway,North\n", "synonyms": "name,country\nNorge,Norway\n",
        "adjectives": 'form,countries\nNordic,"Norway; Multiple countries"\n', "homonyms": "country,needs,not_with\nMali,,mali tree\n",
        "parts": "word,singular,kind\nroot,,simple\nleaves,leaf,simple\nroot tip,,compound\n", "methods": "category,keyword\nmolecular,pcr\nmolecular,sequenc\n",
    }
    for kind, text in lists.items():
        (tmp_path / f"{kind}.csv").write_text(text)
    ref = rf.read(spark, f"file://{tmp_path}")
    assert (ref.countries(), ref.north(), ref.south()) == (["Mali", "Norway"], {"Norway"}, {"Mali"})
    assert ref.adjectives() == {"Nordic": ["Norway"]} and ref.homonyms()[0].not_with == "mali tree"
    assert (ref.parts(), ref.parts("compound"), ref.methods(), ref.regions()) == (["root", "leaves"], ["root tip"], {"molecular": ["pcr", "sequenc"]}, [])
    df = spark.createDataFrame([("norge",), ("MALI ",), ("peru",)], "c string")
    assert [r[0] for r in df.select(ref.country(F.col("c"))).collect()] == ["Norway", "Mali", "Peru"]
    assert [r.country for r in ref.unclassified(df, "c").collect()] == ["Peru"]
    parts = spark.createDataFrame([("leaves",), ("roots",), ("boss",)], "w string")
    assert [r[0] for r in parts.select(ref.part(F.col("w"))).collect()] == ["leaf", "root", "boss"]


def test_second_pass(spark):
    rows = [(1, "from Norge and Mali, and Norge", []), (2, "from Norge", ["Peru"]), (3, "no names", []), (4, None, []), (5, "a Mali tree in Norge", [])]
    df = spark.createDataFrame(rows, "id long, t string, found array<string>")
    got = {r.id: r.found for r in ex.second_pass(df, "t", "found", ["Mali", "Norway"], {"Norge": "Norway"}, [ex.PlaceRule("Mali", not_with="mali tree")]).collect()}
    assert got == {1: ["Norway", "Mali"], 2: ["Peru"], 3: [], 4: [], 5: ["Norway"]}


def test_plurals():
    assert ex.plural_groups(["root", "roots", "xylems", "cortex"], {"stomata": "stoma"}) == {"roots": "root", "stomata": "stoma"}
    assert ex.plural_groups(["a", "as"], exempt=("as",)) == {}


def test_xml_and_search_string(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<Set><PubmedArticle><T>One &lt; two</T><A>x</A><A>y</A></PubmedArticle>\n<PubmedArticle id="2"><A>z</A></PubmedArticle></Set>')
    got = fl.read_xml(spark, f"file://{tmp_path}/a.xml", "PubmedArticle", {"title": "//T"}, {"text": "//A"}).collect()
    assert sorted((r.title or "", r.text) for r in got) == [("", "z"), ("One < two", "x y")]
    assert fl.search_string([["a", "b c"], [], ["d"]]) == '( a OR "b c" ) AND ( d )'


def test_stages(spark, tmp_path):
    to, ran = f"file://{tmp_path}", []

    def write(name):
        def run(s):
            ran.append(name)
            s.range(3).write.mode("overwrite").parquet(f"{to}/{name}")

        return run

    def fails(s):
        raise RuntimeError("no way")

    stages = [wf.Stage("a", write("a"), outputs=[f"{to}/a"]), wf.Stage("b", fails, required=[f"{to}/a"]), wf.Stage("c", write("c"), outputs=[f"{to}/c"])]
    status = lambda **k: [r.status for r in wf.run_stages(spark, stages, **k).orderBy("position").collect()]
    assert status() == ["done", "failed", "not run"] and status(stop_on_error=False) == ["skipped", "failed", "done"]
    assert status(only=["a"], again=True) == ["done"] and ran == ["a", "c", "a"]
    with pytest.raises(ValueError):
        wf.subset(stages, {}, "all")
    with pytest.raises(ValueError):
        wf.validated(spark.range(2), ["nowhere"], 5)
    log: list[str] = []
    assert wf.attempted(lambda: wf.validated(spark.range(0)), spark.range(1), log).count() == 1 and len(log) == 1


def test_recovered(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), (None, None), (None, "3"), ("b", "y")], "k string, v string")
    assert sorted(wf.recovered(df, "k", ["v"]).collect(), key=str) == sorted([("a", 1.0), ("b", None), (None, 3.0)], key=str)


def test_batches_and_backups(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    to = f"file://{tmp_path}/b"
    first = fl.write_batches(df, "id", to, 10, 5)
    assert first.count() == 100 and len(list((tmp_path / "b").glob("step=*"))) == 2
    assert fl.write_batches(df.where("id < 0"), "id", to, 10, 5).count() == 100  # finished steps stay
    (tmp_path / "x.csv").write_text("a\n1\n")
    copy = fl.backup(spark, f"file://{tmp_path}/x.csv", f"file://{tmp_path}/old", "20240101")
    assert copy.endswith("/old/x_20240101.csv") and (tmp_path / "old" / "x_20240101.csv").read_text() == "a\n1\n"


def test_smote_moves_towards_near_neighbours(spark):
    rows = [(i, 1, float(i % 2 * 100 + i / 10), 0.0) for i in range(20)] + [(100 + i, 0, 50.0, 1.0) for i in range(30)]
    out = tr.balanced_by_neighbours(spark.createDataFrame(rows, "id long, y int, a double, b double"), "y", 1, ["a", "b"], 3, "id", near=3).collect()
    made = [r for r in out if r.synthetic]
    assert len(out) == 50 + 60 and len(made) == 60 and all(r.y == 1 for r in made)
    assert all(r.a < 3 or r.a > 99 for r in made)  # never between the two groups
    again = tr.balanced_by_neighbours(spark.createDataFrame(rows, "id long, y int, a double, b double"), "y", 1, ["a", "b"], 3, "id", near=3).collect()
    assert sorted(made) == sorted(r for r in again if r.synthetic)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "good plain words here " + "nice " * (i % 3) if i % 2 else "bad awful words " + "here " * (i % 4), i % 2) for i in range(120)]
    return spark.createDataFrame(rows, "id long, t string, y int")


def test_svm_has_probabilities(labelled):
    out = tr.predicted(tr.linear_svm(labelled, "t", "y"), labelled, "t", "id").collect()
    assert all((r.probability > 0.5) == (r.prediction == 1) == (r.id % 2 == 1) for r in out)


def test_cross_validation_curve_and_importances(spark, labelled):
    best, means = tr.cross_validated(labelled, "t", "y", "id", [{"penalty": 50.0}, {"penalty": 0.01}], folds=2, repeats=1)
    assert best == {"penalty": 0.01} and {r.n for r in means.collect()} == {2}
    curve = tr.learning_curve(labelled, labelled, "t", "y", "id", [0.5, 1.0]).collect()
    assert [r.n for r in curve][1] == 120 and curve[1].accuracy == 1.0
    top = tr.importances(tr.coefficients(tr.elastic_net(labelled, "t", "y")), 3).collect()
    assert {r.feature for r in top} <= {"good", "plain", "nice", "bad", "awful", "here"} and {r.direction for r in top} <= {"Positive", "Negative"}


def test_near_zero_variance(spark):
    df = spark.createDataFrame([(1, i, 0 if i else 1, None) for i in range(100)], "same int, own int, rare int, none int")
    got = {r.name: (r.freq_ratio, r.percent_unique, r.nzv) for r in tr.near_zero_variance(df, ["same", "own", "rare", "none"]).collect()}
    assert got == {"same": (0.0, 1.0, True), "own": (1.0, 100.0, False), "rare": (99.0, 2.0, True)}
    assert math.isclose(tr.correlated(df.withColumn("twice", F.col("own") * 2.0), ["own", "twice", "rare"]).first().correlation, 1.0)


def test_narrowed(spark):
    out = tb.narrowed(spark.createDataFrame([(1, 1.0, 0.5, 70_000), (-100, 2.0, 1.0, 2)], "a long, b double, c double, d long"), ["a", "b", "c", "d"])
    assert [f.dataType.simpleString() for f in out.schema] == ["tinyint", "tinyint", "double", "int"]


def test_strata_are_drawn_as_by_a_full_ranking(spark):
    from pyspark.sql import Window

    df = spark.range(30_000).select("id", F.expr("case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' when id < 100 then null else 'c' end").alias("g"))
    order = Window.partitionBy("g").orderBy(tb.draw("id", 5), "id")
    for quota in (F.expr("case g when 'a' then 500 when 'b' then 0 when 'c' then 100000 else 3 end"), F.lit(4_000), F.lit(None).cast("int")):
        got = sorted(r.id for r in tb.sample_strata(df, "g", quota, "id", 5).collect())
        assert got == sorted(r.id for r in df.withColumn("q", quota).withColumn("n", F.row_number().over(order)).where("n <= q").collect())
    with pytest.raises(ValueError):
        tb.sample_strata(df.withColumn("_q", F.lit(1)), "g", F.lit(1), "id", 5)
    same = spark.range(500).select(F.lit(7).alias("id"), F.lit("a").alias("g"))  # draws that aren't even
    assert tb.sample_strata(same, "g", F.lit(20), "id", 5).count() == 20
