"""Analyses and small operators on literal examples: nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark import workflow as wf
from quillspark.functions import text as tx
from quillspark.operators import analysis as an
from quillspark.operators import models as md
from quillspark.operators import tables as tb


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rates_and_completeness(spark):
    df = spark.createDataFrame([(1, True), (2, None), (3, False), (4, True)], "id long, f boolean")
    assert rows(an.info_rates(df, {"f": F.col("f"), "all": F.lit(True)})) == [("all", 4, 100.0), ("f", 2, 50.0)]
    assert rows(an.info_rates(df.where("id > 9"), {"f": F.col("f")})) == [("f", 0, None)]
    assert [r[0] for r in df.orderBy("id").select(an.completeness(F.col("f"), F.col("id") > 2)).collect()] == [1, 0, 1, 2]


def test_run_matrix_has_every_run(spark):
    df = spark.createDataFrame([(0.9, "a"), (0.1, "a"), (None, "b")], "p double, k string")
    got = rows(an.run_matrix(df, {"m": F.col("p") > 0.5}, {"all": F.lit(True), "b": F.col("k") == "b", "none": F.col("k") == "z"}))
    assert got == [("m", "all", 3, 1, 33.3333), ("m", "b", 1, 0, 0.0), ("m", "none", 0, 0, None)]


def test_flow_and_balance(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "c string")
    assert rows(an.flow([("all", a), ("distinct", a.distinct()), ("none", a.where("c = 'z'"))])) == [(0, "all", 3, None), (1, "distinct", 2, 1), (2, "none", 0, 2)]
    assert rows(an.class_balance({"before": a, "after": a.distinct()}, "c")) == [("after", "x", 1, 50.0), ("after", "y", 1, 50.0), ("before", "x", 2, 66.6667), ("before", "y", 1, 33.3333)]


def test_regions_and_ranks(spark):
    df = spark.createDataFrame([(1, ["Mali", "Norway"]), (2, ["Norway", None]), (3, ["Mali"]), (4, ["Atlantis"]), (5, []), (6, None)], "id int, c array<string>")
    got = {r.id: r.k for r in df.select("id", an.region_class(F.col("c"), ["Norway"], ["Mali"]).alias("k")).collect()}
    assert got == {1: "Both", 2: "North", 3: "South", 4: "Other", 5: "None", 6: "None"}
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "v string")
    found = spark.createDataFrame([("b",), ("b",), ("c",), ("z",), (None,)], "v string")
    assert rows(an.known_counts(known, found, "v")) == [("a", 0), ("b", 2), ("c", 1)]
    assert rows(an.extremes(known, found, "v", 1)) == [("bottom", "a", 0), ("top", "b", 2)]
    assert rows(an.below(known, found, "v", 2)) == [("a", 0), ("c", 1)]


def test_lists(spark):
    df = spark.createDataFrame([("root; leaf; root",), ("leaf",), (None,), ("",)], "p string")
    assert rows(an.per_document(df, "p")) == [(0, 2), (1, 1), (2, 1)]
    assert rows(an.top_values(df, "p", excluded=["root"])) == [("leaf", 2)]
    assert rows(an.top_values(df, "p", n=1)) == [("leaf", 2)]  # a tie goes by value


def test_shares(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", True), (3, "a", None), (1, "a", True)], "k int, g string, f boolean")
    assert rows(an.share_of_all(df, "k", F.col("f"))) == [(0.333333,)]
    assert rows(an.share_by(df, "k", "g")) == [("a", 3, 100.0), ("b", 1, 33.3333)]


def test_grid_and_best(spark):
    df = spark.createDataFrame([(0.9, 0.5, "P"), (0.2, 0.2, "A"), (0.6, 0.1, "A"), (None, 0.5, "P")], "a double, b double, t string")
    grid = md.weight_grid(df, "a", "b", "t", "P", [0.5, 1.0], [0.5, 0.7])
    assert rows(grid) == [(0.5, 0.5, 1.0, 1.0), (0.5, 0.7, 1.0, 1.0), (1.0, 0.5, 1.0, 0.5), (1.0, 0.7, 1.0, 1.0)]
    assert rows(an.best_config(grid, ["presence_recall", "absence_recall"], ["weight", "threshold"])) == [(0.5, 0.5, 1.0, 1.0)]
    assert rows(an.best_config(grid.where("weight > 9"), ["presence_recall"], ["weight"])) == []


def test_cascade(spark):
    df = spark.createDataFrame([(0.9, 0.9), (0.1, 0.9), (None, 0.1)], "a double, b double")
    got = [r[0] for r in df.select(md.cascade([(F.col("a"), 0.6, F.lit("x")), (F.col("b"), 0.6, F.lit("y"))])).collect()]
    assert got == ["x", "y", "Uncertain"]


def test_labels_and_lookups(spark):
    df = spark.createDataFrame([("Presence (sure)",), ("absent",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(tx.labelled_by(F.col("c"), {"^pres": "P", "^abs": "A"}, "?")).collect()] == ["P", "A", "?", "?"]
    assert [r[0] for r in df.select(tx.looked_up(F.col("c"), {"absent": 0})).collect()] == [None, 0, None, None]
    assert [r[0] for r in df.select(tx.categories_found(F.col("c"), {"s": ["SURE", "x"], "a": ["abs"]})).collect()] == [["s"], ["a"], [], []]
    assert [r[0] for r in df.select(tx.contains_any(F.col("c"), ["sure", "abs"])).collect()] == [True, True, None, False]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    assert tb.first_names(df).columns == ["a", "b"] and rows(tb.first_names(df)) == [(1, 2)]
    assert tb.column_sets(["b", "a", "a"], ["a", "c"]) == {"shared": ["a"], "only_first": ["b"], "only_second": ["c"], "all": ["b", "a", "c"]}
    times = spark.createDataFrame([("x", 2), ("y", 0), ("z", None)], "v string, n int")
    assert rows(tb.repeated(times, "n", "i")) == [("x", 2, 1), ("x", 2, 2)]


def test_profile(spark):
    df = spark.createDataFrame([("P", "a", 1990, 10, "x; y"), ("P", "b", 2000, 20, "y"), ("A", "a", 1995, 30, None)], "l string, o string, y int, n int, c string")
    got = {(r.section, r.label, r.name): r.value for r in an.training_profile(df, "l", "o", "y", "n", "c", 1).collect()}
    assert got["labels", "P", "n"] == 2 and got["lengths", "P", "mean"] == 15 and got["years", "A", "first"] == 1995
    assert got["origins", "P", "b"] == 1 and [k for k in got if k[0] == "top"] == [("top", None, "y")]


def test_a_row_that_raises_stops_no_other(spark):
    df = spark.createDataFrame([(1, "4"), (2, "x"), (3, None), (4, "9")], "id long, v string")
    got = rows(wf.row_by_row(df, "id", lambda r: {"n": int(r["v"])}, "n long").select("id", "n", "status"))
    assert got == [(1, 4, "ok"), (2, None, "error"), (3, None, "error"), (4, 9, "ok")]
    wrong = rows(wf.row_by_row(df.limit(1), "id", lambda r: {"n": "no number"}, "n long").select("n", "status"))
    assert wrong == [(None, "error")]
    assert rows(wf.row_by_row(df.where("id > 9"), "id", lambda r: {}, "n long")) == []


@pytest.mark.parametrize("text, want", [("of the end", "of the end"), (None, None), ("", None), ("nothing here", None)])
def test_context_chars(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.context_chars(F.col("t"), "of the")).first()[0] == want


def test_first_by_text(spark):
    df = spark.createDataFrame([(3, "A b."), (1, "a  B"), (2, None), (4, " - "), (5, ""), (6, " "), (7, "a b")], "id long, t string")
    assert rows(tb.first_by_text(df, "t", ["id"], ["id"])) == [(1,), (2,), (4,), (5,), (6,)]
    assert rows(tb.first_by_text(df, "t", ["id"]).where("id = 1")) == [(1, "a  B")]
    assert rows(tb.first_by_text(df, "t", [F.desc("id")], ["id"])) == [(2,), (4,), (5,), (6,), (7,)]


def test_spread_keeps_all_rows(spark):
    df = spark.range(10).selectExpr("nullif(id, 3) as id").coalesce(1)
    assert tb.spread(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert rows(tb.spread(df, "id")) == rows(df)
    wide = df.repartition(64)
    assert tb.spread(wide, "id") is wide
