"""The text pipeline: stages over `documents`, each working on all that the one before it kept.

Toxic documents go; of equal texts the row with the largest doc_id stays; of near-duplicates (five-word shingles,
similarity 0.8) the one with the smallest; the rest is mixed to the sources' target weights, which drops, cuts or
repeats documents; the mix is packed into token sequences. Columns beside those of documents pass through the first four
stages, whatever their names. No documents in, no rows out of any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roomtide.llm import exact, mixing, neardup, packing, toxicity
from roomtide.llm.common import importable, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain does not reject, columns as given. It is trained on the labelled documents among
    them. Null text has only the prior; rows that repeat are judged alike; without labels nothing goes."""
    importable(spark)
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal text the one with the largest doc_id, null text being empty; ties in doc_id leave one row."""
    importable(spark)
    return exact.keep_one_of_each(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the rows with the smallest doc_id; empty texts and rows without a doc_id stay."""
    importable(spark)
    return neardup.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, once for each epoch, the one at a source's cut with its first words only; a null source is a
    source, and documents without words are not taken."""
    importable(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences, every id of every row in one piece; null text is the end id alone."""
    importable(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("drop_toxic", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix),
    ("pack_sequences", pack),
]

#: Sketches, trained models and tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in `sf_dir`; each result is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
