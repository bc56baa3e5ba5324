"""A corpus pipeline of five stages; each takes what the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet and
reread as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logtide.llm import bpe, exact_dedup, language, mixing, near_dedup
from logtide.llm.common import documents
from logtide.operators.ordering import new_path, removed, scope


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or with a narrow margin, learned from these documents, go."""
    return language.accepted_documents(docs, language.train(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the smallest id; of rows with equal id and text, one."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the smallest id."""
    return near_dedup.near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and what they decode to, as digests."""
    ranks = bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, kept=["doc_id"]))


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL expresses neither compression nor byte-pair merges; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage on what the others kept; tables that no later stage reads are removed."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scope(spark, f"stage-{name}"):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
