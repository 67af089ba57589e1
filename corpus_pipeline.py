"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes the documents that the one before has kept, written as Parquet
and read again.  All but the last return the columns of `documents`.

Edge cases: rows with a null id go through like others; null and empty texts fall
to the quality rules; of equal rows and near copies one stays, a named one if
there is any; a null source is a source of its own; very long texts are taken
whole; columns beyond those of `documents` are carried along, whatever their
names; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from configsieve.llm import mixing, ngram_join, packing, rules, toxicity
from configsieve.llm.storage import settled, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic; the machine learns from the labels of the documents it is given."""
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what a rule of the cascade rejects."""
    small_batches(spark)
    return rules.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    small_batches(spark)
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take of each source the words that its weight gives it; `n_chars` follows the text."""
    small_batches(spark)
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in mixed.columns else mixed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, f"stage-{k}")
    return docs
