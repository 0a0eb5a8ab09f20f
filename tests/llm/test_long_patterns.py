"""Texts of a megabyte made of the characters of the patterns for personal data and secrets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm")
from quillspark.llm import privacy, secrets  # noqa: E402

UNITS = ["a.", "a", "A", "1", "1-", "1 ", "12 ", "1.", "@", "a@", "a@b.", "Mr ", "Mr Bo ", "+1 ", "DE12 ", "token=", "token = '", "-", "("]


@pytest.fixture(scope="module")
def long(spark):
    rows = [(i, head + u * (1_000_000 // len(u)) + " end") for i, (u, head) in enumerate([*((u, "") for u in UNITS), ("a.", "x@"), ("1.", "x@"), ("0-", "password: ")])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows))


def test_personal_data(long):
    out = privacy.pseudonymised(long, "key")
    assert out.agg(F.count("*"), F.min(F.length("text"))).first()[0] == len(UNITS) + 3


def test_secrets(long):
    assert secrets.redact(long).agg(F.count("*"), F.min(F.length("text"))).first()[0] == len(UNITS) + 3
