"""From raw documents to packed sequences, in five stages; counted as part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's docs. An
empty table gives an empty one in every stage, and all but the last keep the columns of documents, whatever more there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnfield.llm import language, nearcopies, packing, quality, secrets
from cairnfield.llm.common import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, repeated rows stay or go together."""
    return quality.kept_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; learned from the labelled documents that came this far and aren't held out.

    Without any labelled document there is nothing to judge by, and all stay; else null texts and texts without letters go.
    """
    model = language.learn(docs)
    return language.kept_documents(docs, model) if model.languages else docs


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: operator 6 with fingerprints wide enough for a similarity of 0.8 of five-word
    shingles, and an exact check. Texts without words are copies of each other, and so are repeated rows."""
    return nearcopies.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mask; null and empty texts and repeated rows stay as they are."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences and offsets; a null or empty text is one piece."""
    return packing.packed_documents(docs)


STAGES = [("quality", quality_rules), ("language", language_id), ("near_dedup", near_dedup), ("secrets", secret_scan), ("packing", pack)]
#: Language scores, the randomness tests and BPE are beyond SQL; tests/llm has a brute-force version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
