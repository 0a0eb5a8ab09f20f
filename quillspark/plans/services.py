"""Queries over paged services, which answer from recorded pages of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources import files as fl
from quillspark.sources import paged as pg

from .registry import DOCS, docs, register

YEARS = [(y, min(y + 4, 2024)) for y in range(1980, 2025, 5)]
FETCH = "quillspark.sources.paged:recorded"
#: What XML can't hold, in SQL and here.
ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _records(s, d) -> DataFrame:
    d = docs(s, d)
    return d.select("id", F.substring("abstract", 1, 40).alias("title"), F.col("lang").alias("surname"), F.substring("source", 1, 1).alias("initials"), F.concat(F.lit("10.1/"), "id").alias("doi"), "year", F.col("source").alias("journal"), "abstract")


@register(
    "SRC11",
    rf"""WITH {DOCS} SELECT regexp_replace(substr(abstract, 1, 40), '{ILLEGAL}', '', 'g') AS title, nullif(concat_ws(' ', lang, left(source, 1)), '') AS authors, '10.1/' || id AS doi,
    year::VARCHAR AS year, source AS journal, regexp_replace(coalesce(abstract, ''), '{ILLEGAL}', '', 'g') AS abstract FROM docs""",
)
def pubmed(s, d):
    """Ranges of years, XML pages, and a service that ends after so many records, so that ranges are halved,
    down to days of a year."""
    folder, window = fl.scratch(s, "service"), 10_000
    dated = _records(s, d).withColumn("day", F.pmod(F.xxhash64("id"), F.lit(365)) + 1)
    pg.record(dated, folder, "year", "id", YEARS, 200, pg.xml_answer, window, "day")
    read = pg.read_pages(s, "title string, authors string, doi string, year string, journal string, abstract string", FETCH, folder=folder, format="xml", first=1980, last=2024, years=5, limit=200, window=window, days=True)
    return _good(read)


def _good(read: DataFrame) -> DataFrame:
    """Records only; a failed request stops the query instead of missing silently."""
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("failed:"), "request", "error"))).otherwise(F.lit(True))
    return read.where(checked).drop("request", "error")


@register("SRC13", f"WITH {DOCS} SELECT substr(abstract, 1, 40) AS title, lang AS surname, '10.1/' || id AS doi, substr(year::VARCHAR || '-05-01', 1, 4) AS year, source AS journal, abstract FROM docs")
def scopus(s, d):
    """Offsets until the total is reached; the year is cut from the date."""
    folder = fl.scratch(s, "service")
    dated = _records(s, d).withColumn("date", F.concat(F.col("year").cast("string"), F.lit("-05-01")))
    pg.record(dated, folder, "year", "id", YEARS, 200, pg.json_answer)
    read = pg.read_pages(s, "title string, surname string, doi string, date string, journal string, abstract string", FETCH, folder=folder, first=1980, last=2024, years=5, limit=200)
    return _good(read).select("title", "surname", "doi", F.substring("date", 1, 4).alias("year"), "journal", "abstract")


@register("SRC14", f"WITH {DOCS} SELECT substr(abstract, 1, 40) AS title, lang AS authors, '10.1/' || id AS doi, source, abstract FROM docs")
def wos(s, d):
    """Offsets until a page is empty; a field that a record lacks is null."""
    folder = fl.scratch(s, "service")
    pg.record(_records(s, d).withColumnRenamed("surname", "authors").withColumnRenamed("journal", "source"), folder, "year", "id", YEARS, 100, pg.json_answer)
    read = pg.read_pages(s, "title string, authors string, doi string, source string, abstract string", FETCH, folder=folder, first=1980, last=2024, years=5, limit=100, paging="empty")
    return _good(read)
