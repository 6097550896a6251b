"""Corpus pipeline: five stages over ``documents``, each written and read again.

Quality, line dedup, near-duplicate removal and decontamination return the columns of
documents, extra ones of any name included; the last returns each document's token digests.

Nulls, blanks: a null text counts as empty everywhere and stays null where it is kept; empty
texts are scored like others, and of those that are kept one stays, as near duplicates of each
other. A document whose lines are all repeats goes on with an empty text. A null doc_id stays
where no row of its group has an id; rows that share an id are kept and dropped each for its own
text. Repeated rows keep their first copy: the least (doc_id, key) of a group. Without labels
every score is 0.5, and all documents stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tastegraph.llm import bpe, decontam, lines, quality, simhash
from tastegraph.llm.queries import tokenizer_path
from tastegraph.plans.scratch import materialize


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs, shingles=lines.stretches)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.code_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", _quality),
    ("line_dedup", _lines),
    ("simhash_near_dedup", _near_duplicates),
    ("benchmark_decontamination", _decontaminate),
    ("bpe_encoding", _encode),
]

#: The stages are trained, iterative or tokenizing: SQL can express none of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
