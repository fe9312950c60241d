"""The corpus pipeline: five stages over ``documents``, each one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it
as Parquet and reads it again as the next stage's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from testpulse.llm import linededup, packing, quality, simhash, toxicity
from testpulse.llm.columns import table
from testpulse.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.keep_good(docs)


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models find toxic go; the labels are those of the tables."""
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go out of the texts; a text that was nothing else goes."""
    return linededup.remove_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, with the sequence and place of each."""
    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER_FILE))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_texts),
    ("line_dedup", repeated_lines),
    ("simhash", near_duplicates),
    ("packing", packed),
]

#: The models, near duplicates and tokens cannot be put in SQL; tests hold each stage
#: against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
