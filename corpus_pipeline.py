"""Corpus pipeline: five operators of ``casekit.llm`` in turn, each stage written as Parquet and reread.

Every stage takes ``(spark, docs, sf_dir)`` and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casekit.llm import decontaminate, mixing, neardup, quality, tokens
from casekit.llm.common import new_folder, table

TOKENIZER = "word_bpe_49k.json"
#: Words a worker remembers: four other stages share the executors' memory.
MEMO = 200_000
#: Similarity in per cent of near copies; operator 10's own query has 85.
NEAR_PERCENT = 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 and above) stays, that with the smallest id."""
    return neardup.keep_one(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: a document stands in the mix as often as it was taken."""
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns their documents as read back."""
    return tokens.tokenized(docs, public_tokenizers.path(TOKENIZER), memo=MEMO)


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("source_mix", source_mix), ("token_output", token_output)]

#: The quality model, similarity join and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
