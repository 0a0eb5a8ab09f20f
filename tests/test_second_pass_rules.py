"""The second pass keeps to the words that a name's rule needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import extraction as ex


def test_needed_words(spark):
    df = spark.createDataFrame([(1, "in Niger there"), (2, "in Niger, the republic"), (3, None)], "id long, t string").withColumn("found", F.array().cast("array<string>"))
    rules = [ex.PlaceRule("Niger", needs="republic")]
    assert {r.id: r.found for r in ex.second_pass(df, "t", "found", ["Niger"], {}, rules).collect()} == {1: [], 2: ["Niger"], 3: []}
    got = ex.places(df.drop("found"), "t", {"Niger": ""}, rules, {}, {}, [], [], set(), again=True).collect()
    assert {r.id: r.countries_detected for r in got} == {1: "", 2: "Niger", 3: ""}
