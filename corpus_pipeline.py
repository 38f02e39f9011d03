"""Corpus pipeline: from documents to packed training sequences.

toxicity drops the documents that the classifier rejects by the threshold of their language;
near_duplicates keeps one document of each group of texts whose 5-word shingles have a Jaccard
similarity of 0.8 or more, found by SimHash at a wide radius and verified; personal_data replaces
personal data in the texts; mixing draws every document at least once and small sources up to
MAX_PASSES times, in permuted blocks; packing cuts the texts' tokens into sequences and returns the
pieces with their ids. Each stage reads what the one before it kept.

Defined results: rows with nulls in any column, empty texts and repeated rows go through every stage
as its operator says (an empty text is a document; empty texts are one group, of which one stays);
columns that the operators don't use are kept up to packing, whatever their names; an empty table of
documents gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierflow.llm.base import settle
from tierflow.llm.mixing import mixed_documents
from tierflow.llm.packing import pack
from tierflow.llm.pii import sanitise
from tierflow.llm.simhash import without_near_duplicates
from tierflow.llm.toxicity import without_toxic

#: Passes over the smallest sources for each one over the largest.
MAX_PASSES = 1.25


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, max_passes=MAX_PASSES)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained classifier, groups of similar texts and packing can't be written in SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
