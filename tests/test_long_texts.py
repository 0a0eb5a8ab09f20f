"""Texts of a megabyte made of the characters that a pattern repeats: no pattern may need the stack for them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import extraction as ex

MB = 1_000_000
#: What repeated groups and classes consist of.
UNITS = ["a'", "a", "1", "1,234", "Abc ", "abc ", "Abc\n", "a-", " ", "\n", ".", "A. b ", "5 ", "é'x"]


@pytest.fixture(scope="module")
def long(spark):
    rows = [(u, u * (MB // len(u)) + " end") for u in UNITS]
    return spark.createDataFrame(rows, "unit string, text string").repartition(len(UNITS)).cache()


def test_words(long):
    got = {r.unit: (r.n, r.first) for r in long.select("unit", F.size(tx.words(F.col("text"))).alias("n"), F.substring(F.element_at(tx.words(F.col("text")), 1), 1, 5).alias("first")).collect()}
    assert got["a'"] == (2, "a'a'a") and got["abc "][0] == MB // 4 + 1 and got["."][0] == 1


@pytest.mark.parametrize(
    "expression",
    [
        lambda c: F.size(tx.candidate_names(c)),
        lambda c: tx.leading_count(c),
        lambda c: F.length(tx.normalize_text(c)),
        lambda c: F.size(tx.tokens(tx.preprocessed(c))),
        lambda c: tx.phrase_score(c, {"k": (1, ["no * were found", "not present"])}),
        lambda c: tx.context_chars(c, "is absent"),
        lambda c: F.size(tx.extract_words(c, ["leaf", "root hair"])),
        lambda c: tx.labelled_by(c, {r"university\s+of": "x"}),
        lambda c: ex.has_coordinates(c),
    ],
)
def test_expressions(long, expression):
    assert len(long.select("unit", expression(F.col("text")).alias("x")).collect()) == len(UNITS)


def test_second_pass(long, spark):
    out = ex.second_pass(long.withColumn("found", F.array().cast("array<string>")), "text", "found", ["Abc"], {})
    assert len(out.collect()) == len(UNITS)
    few = spark.createDataFrame([("In New  Zealand DeF and Chad and ChadX. Peru", [])], "text string, found array<string>")
    assert ex.second_pass(few, "text", "found", ["New Zealand", "Chad", "Peru"], {}).first().found == ["Chad", "Peru"]
    assert ex.second_pass(few.withColumn("text", F.lit("old New  Zealand")), "text", "found", ["New Zealand"], {}).first().found == ["New Zealand"]
