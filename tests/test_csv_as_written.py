"""Texts of awkward forms come back from CSV as they were written."""

from __future__ import annotations

import pytest

from quillspark.plans import catalogue
from quillspark.sources import files as fl

TEXTS = [None, "", " ", "  a", "a ", "\ta\t", "\n", "\na", "a\n", "\r", "a\rb", "a\r\n", "\r\n" * 50_000, '"', '""', ' "a" ', '\r"y', 'a "b", c', "\\", 'a\\"b', "#a", "\x00", '\x00"a\nb', "a,\x00\x00", '\x00""\x00,"\x00', "\x01\x0b", "null", "\ufeffa", "a\ufffdb", "\xa0a\u2028", "Müller"]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder with documents of such texts, and the rows."""
    d = str(tmp_path_factory.mktemp("awkward"))
    rows = [*enumerate(TEXTS), (len(TEXTS), "the last")]
    df = spark.createDataFrame([(i, t, (None, "", "en")[i % 3], " web", i) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(2, "doc_id").write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_pruned(spark, awkward):
    got = catalogue.queries()["SRC4"](spark, awkward[0]).collect()
    assert sorted((int(r.doc_id), r.text) for r in got) == awkward[1]


def test_replacement_characters_of_a_text_are_utf8(spark, awkward):
    got = catalogue.queries()["SRC7"](spark, awkward[0]).collect()
    assert sorted((r.doc_id, r.text) for r in got) == awkward[1]


def test_bytes_decide_the_encoding(spark, tmp_path):
    read = lambda name, data: ((tmp_path / name).write_bytes(data), [tuple(r) for r in fl.read_with_fallback(spark, f"{tmp_path}/{name}").collect()])[1]
    assert read("u.csv", 'k,t\n1,"a\ufffd\nü"\n'.encode()) == [("1", "a\ufffd\nü")]
    assert read("l.csv", 'k,t\n1,"a\nü"\n2,\xc3b\n'.encode("latin-1")) == [("1", "a\nü"), ("2", "\xc3b")]
    (tmp_path / "h.csv").write_bytes("k,ü\n1,a\n".encode("latin-1"))
    assert fl.read_with_fallback(spark, f"{tmp_path}/h.csv").columns == ["k", "ü"]


def test_other_separator(spark, tmp_path):
    rows = [(str(i), t) for i, t in enumerate(["a\tb", " ", "", None, "c\n"])]
    fl.write_csv(spark.createDataFrame(rows, "k string, t string"), f"{tmp_path}/out", sep="\t")
    assert sorted(map(tuple, fl.read_delimited(spark, f"{tmp_path}/out", sep="\t", empties=True).collect())) == rows


def test_exports_of_others_keep_quoted_empties_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title,doi\n1,"",\n')
    assert tuple(fl.read_delimited(spark, f"{tmp_path}/a.csv").first()) == ("1", None, None)
    assert tuple(fl.read_delimited(spark, f"{tmp_path}/a.csv", empties=True).first()) == ("1", "", None)
