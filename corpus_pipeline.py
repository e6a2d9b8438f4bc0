"""From documents to packed training sequences.

Every stage works on all rows that the one before kept; each result is written
as Parquet in the session's shared folder and read again. Stages return the
columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowferry.llm import langid, packing, pii, rules, simhash
from rowferry.llm.queries import WORD_BPE
from rowferry.scratch import materialize

#: Documents whose mean probability of any language is lower are rejected.
LEAST_SCORE = 0.35


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table; null and empty texts fail it."""
    return rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from docs; texts without a letter go, and all if no language is labelled."""
    return langid.keep_known(docs, langid.fit(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data hidden; n_chars follows the text."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Language, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
