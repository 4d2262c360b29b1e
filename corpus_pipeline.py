"""Corpus preparation: filter, deduplicate, decontaminate, mask and mix the documents table.

All stages work on whole texts and take any further columns, which they hand on; an empty table gives an empty
one with the same columns, and rows that repeat stay or go by the rules below. Columns that a stage adds while
it works have names that the table does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakelink.llm import decontam, mixing, neardup, quality, secrets
from lakelink.llm.common import read, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts fail. Null languages and sources are values of their own; equal texts of one language
    and source stay or go together.
    """
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least id, null last; of rows that are the same one stays.

    Empty texts, should there be any, all stay.
    """
    return neardup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; without items, or without a word, all stay."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, secrets masked; n_chars follows. A null text stays null."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of sources, languages and topics, as far as these have tokens.

    Rows that repeat an id stay or go together; a document without a word has the rate of its cell.
    """
    return mixing.sample(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("mix", mix),
]

#: The outlier estimates, near-duplicate groups and the forest are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
