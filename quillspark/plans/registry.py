"""The catalogue's queries by the identifiers of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.tables import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Documents as bibliographic records: SQL and the DataFrame below say the same.
DOCS = "docs AS (SELECT doc_id AS id, text AS abstract, source, lang, n_chars, 1980 + doc_id % 45 AS year FROM documents)"
#: Labels as classifications with a made-up, fixed confidence.
CLASSES = "classes AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'Absence' ELSE 'Presence' END AS label, CASE WHEN quality = 1 THEN 'Presence' ELSE 'Absence' END AS guess, (doc_id * 37 % 101) / 100.0::DOUBLE AS conf, (doc_id * 53 % 101) / 100.0::DOUBLE AS conf2 FROM labels)"


def register(name: str, sql: str | None):
    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("abstract"), "source", "lang", "n_chars", (1980 + F.col("doc_id") % 45).alias("year"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, "Absence").otherwise("Presence").alias("label"),
        F.when(F.col("quality") == 1, "Presence").otherwise("Absence").alias("guess"),
        (F.col("doc_id") * 37 % 101 / F.lit(100.0)).alias("conf"),
        (F.col("doc_id") * 53 % 101 / F.lit(100.0)).alias("conf2"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs`` for work on whole texts, over all cores also where the table is one small file."""
    return spread(docs(spark, sf_dir).select("id", "abstract"), "id")
