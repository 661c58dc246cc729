"""The corpus pipeline: five stages over ``documents``, each one of the operators in ``lossframe.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
its result as Parquet in the shared folder and reads it again as the next
stage's documents. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lossframe.llm import bpe, decontaminate, exact_dedup, language, simhash
from lossframe.llm.common import scratch, table

#: Shingle length and bit distance of the near-duplicate stage.
SHINGLE, DISTANCE = 4, 4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go."""
    return language.known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal fingerprints, the row with the smallest doc_id stays."""
    return simhash.one_of_each(docs, SHINGLE, DISTANCE)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least one word in twenty inside a benchmark window go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", contaminated),
    ("BPE encoding and decoding", token_digests),
]
#: Language ID, SimHash components and BPE have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
