"""Learning curves make their rows once, and learners take words for texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import training as tr


def test_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(i):
        made.add(1)
        return ["Red fox", "blue owl's nest", None][i % 3]

    rows = spark.range(60).select("id", told(F.col("id").cast("int")).alias("t"), (F.col("id") % 2).cast("int").alias("y"))
    got = tr.learning_curve(rows, rows, "t", "y", "id", [0.5, 1.0]).collect()
    assert made.value == 120  # as training and as test rows; not once a pass
    assert [r.share for r in got] == [0.5, 1.0] and got[1].n == 60 and 0 < got[0].n < 60
    seen = []

    def fit(some, text, label):
        seen.append(some.schema[text].dataType.simpleString())
        return tr.elastic_net(some, text, label)

    assert [tuple(r) for r in tr.learning_curve(rows, rows, "t", "y", "id", [0.5, 1.0], fit=fit).collect()] == [tuple(r) for r in got]
    assert seen == ["string", "string"]  # another's learner gets the texts


def test_terms_of_words(spark):
    df = spark.createDataFrame([(1, "Red fox's den"), (2, None)], "id long, t string")
    once = tr.terms(df, "t")
    assert [r.terms for r in once.orderBy("id").collect()] == [["red", "fox's", "den"], []]
    assert [r.terms for r in tr.terms(once, "terms").orderBy("id").collect()] == [["red", "fox's", "den"], []]
