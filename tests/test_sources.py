"""Files with differing headers, encodings and fallbacks; checkpoints; streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import tables as tb
from quillspark.operators import training as tr
from quillspark.sources import files as fl
from quillspark.streaming import arriving, counts_by_window


def test_headers_are_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title\n1,"with, comma"\n2,"two\nlines"\n')
    (tmp_path / "b.csv").write_text("title,year\nthree,1999\n")
    got = sorted(map(tuple, fl.read_delimited(spark, f"{tmp_path}/*.csv").select("id", "title", "year").collect()), key=repr)
    assert got == sorted([("1", "with, comma", None), ("2", "two\nlines", None), (None, "three", "1999")], key=repr)
    with pytest.raises(FileNotFoundError):
        fl.read_delimited(spark, f"{tmp_path}/none*.csv")


def test_latin1_fallback(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name\nM\xfcller\n".encode("latin-1"))
    assert fl.read_with_fallback(spark, f"{tmp_path}/a.csv").first().name == "Müller"


def test_checkpoint_is_reused(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    assert fl.checkpointed(spark.range(3), path).count() == 3
    assert fl.checkpointed(spark.range(5), path).count() == 3
    assert fl.checkpointed(spark.range(5), path, again=True).count() == 5


def test_positions(spark):
    df = spark.createDataFrame([(x, -x) for x in (5, 3, 9, 1)], "k int, v int")
    assert {r.k: r._position for r in tb.positioned(df, ["k"]).collect()} == {1: 0, 3: 1, 5: 2, 9: 3}


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, n int")
    assert fl.markdown(df).split("\n")[2] == "| a | 1 |"


def test_classifiers_learn(spark):
    rows = [(i, "good fine words" if i % 2 else "bad poor words", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string, y int")
    for fit in (tr.elastic_net, tr.linear_svm):
        got = tr.predicted(fit(df, "t", "y"), df, "t", "id").join(df, "id")
        assert got.where("prediction <> y").count() == 0


def test_stream_counts(spark, tmp_path):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(9)], "m int, k string").withColumn("ts", F.expr("timestamp_seconds(m * 60)"))
    df.write.parquet(f"{tmp_path}/in")
    out = counts_by_window(arriving(spark, f"{tmp_path}/in", df.schema), "ts", "k", "5 minutes", "1 minute")
    q = out.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    try:
        q.processAllAvailable()
        got = {(r.k, r.window.start.minute): r["count"] for r in spark.table("windows").collect()}
    finally:
        q.stop()
    assert got == {("a", 0): 3, ("b", 0): 2, ("a", 5): 3, ("b", 5): 1}


def test_reports_say_what_they_leave_out(spark):
    df = spark.range(7)
    assert fl.markdown(df, 5).split("\n")[-1] == "(2 more rows)" and "more" not in fl.markdown(df, 7)
    assert fl.report("T", {"s": df}, 3)[-1] == "(4 more rows)" and len(fl.report("T", {"s": df}, 7)) == 2 + 3 + 7


def test_top_with_ties_without_keys(spark):
    from quillspark.operators import tables as tb

    df = spark.createDataFrame([(1,), (5,), (5,), (3,), (3,), (None,), (None,)], "v int")
    top = lambda n: sorted((r.v for r in tb.top_with_ties(df, "v", n).collect()), key=lambda v: (v is None, v))
    assert top(1) == [5, 5] and top(3) == [3, 3, 5, 5] and top(5) == [1, 3, 3, 5, 5] and top(6) == [1, 3, 3, 5, 5, None, None]
    assert tb.top_with_ties(df.limit(0), "v", 2).collect() == []
