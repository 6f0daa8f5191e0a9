"""Corpus pipeline: each stage reads what its predecessor kept and wrote as Parquet.

1. quality rules: documents that fail them go;
2. line dedup: lines that repeat, exactly or within a few edits, go; documents left without a line go;
3. SimHash near-dedup: one document of each group stays;
4. mixing: sources come to their target weights; a document appears once per pass that takes words of it;
5. SentencePiece encoding and decoding: ids and decoded text of every row as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldshift.llm import line_dedup, mixing, quality, sentencepieces, simhash
from fieldshift.llm.queries import tokenizer_path
from fieldshift.llm.tables import read, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("simhash_dedup", near_duplicates),
    ("mixing", target_weights),
    ("sentencepiece", encode),
]

#: SQL can't express XXH64 fingerprints, the permutations or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
