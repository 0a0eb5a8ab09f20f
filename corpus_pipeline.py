"""A corpus pipeline of five stages over the whole of ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the
columns of ``documents``; the last returns the places of the packed pieces. Toxic documents,
near-duplicates (five-word shingles, similarity of 0.8 or more; the smallest doc_id of a group
stays) and documents that hold a benchmark item go; secrets are cut out of the texts.

Defined cases, of all stages: documents with null or empty text and rows without a doc_id pass; rows
that are repeated as a whole or share a doc_id are judged each, and stay or go alike where their texts
do; whole texts are read, whatever their length; further columns stay up to the last stage, which has
its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, jaccard_join, packing, secrets, toxicity
from quillspark.llm.common import discard, fresh, small_batches, stored, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on those with labels, doesn't reject; texts without words pass."""
    small_batches(spark)
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose doc_id names their group stay, and rows without a doc_id. Texts without words are linked
    with nothing; of equal texts the smallest doc_id stays, with all of its rows."""
    small_batches(spark)
    named = jaccard_join.join(docs, 5, 80, 100)
    copy = fresh(docs, "copy")[0]
    dropped = named.where("doc_id <> component_id").select(F.col("doc_id").alias(copy)).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col(copy), "left_anti")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item aligns; an empty benchmark lets all pass."""
    small_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and ``n_chars`` of the new text; null texts stay null."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places; null texts count as empty and give the end id alone."""
    import public_tokenizers

    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("jaccard_join", distinct_texts),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The trained classifier, the alignment and the tokenizer can't be put in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
