"""A training corpus from ``documents``: languages, quality, near duplicates, mix, packed sequences.

Every stage is a function of (spark, docs, sf_dir) that works on all documents its
predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrina.llm import langid, minhash, mixing, packing, quality
from vitrina.llm.common import prepared, table
from vitrina.llm.queries import GRADES, learnt_from, ratings
from vitrina.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is decided."""
    prepared(spark)
    return langid.accepted(docs, langid.fit(learnt_from(docs)))


def graded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are most likely of the highest grade."""
    prepared(spark)
    return quality.selected(docs, quality.fit(docs, ratings(spark, sf_dir), GRADES))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    prepared(spark)
    return minhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents until each source has its share of words."""
    prepared(spark)
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens."""
    prepared(spark)
    return packing.packed(docs)


STAGES = [
    ("language", language), ("quality", graded), ("near duplicates", distinct), ("mixing", mixed), ("packing", packed),
]

# The language and quality models are trained, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
