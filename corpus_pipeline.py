"""From raw documents to encoded training text: five stages, each over what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memberlens.llm import decontamination, ngram_join, quality, sentencepieces, toxicity
from memberlens.llm.common import read_table
from memberlens.session import stage

PIECES = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_ones(docs, read_table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_chunks): ids are little-endian 32-bit numbers in one binary."""
    return sentencepieces.encode(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece_encoding", encode),
]

#: classifiers and tokenizers are beyond SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
