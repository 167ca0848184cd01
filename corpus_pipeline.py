"""A corpus pipeline of five stages: language, boilerplate lines, near duplicates, benchmark passages, encoding.

Every stage takes all that its predecessor kept and its decisions take effect; each result is written as Parquet before the
next stage reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cliploom.llm import bpe, decontaminate, jaccard, language, lines
from cliploom.llm.common import scratch_dir, table

TOKENIZER = "byte_bpe_50k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go (no letters, or like none of the learned languages)."""
    return language.drop_rejected(docs, language.train(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by five sites and more stay in the document with the smallest id only; all documents stay."""
    return lines.drop_boilerplate(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles the one with the smallest id stays."""
    return jaccard.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words that benchmark items have are cut; all documents stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe_round_trip", encoding_stage),
]

# Language models and byte-pair encoding have no SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/cliploom/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


def load() -> tuple[dict, dict]:
    """Queries and SQL to register."""
    return {"pipeline": run}, {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
