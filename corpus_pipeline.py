"""A training-corpus pipeline: each stage takes what the one before kept, and its decisions take effect.

Stages 1 to 4 return the columns of ``documents``; the last returns one row for each packed piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import langid, mixing, neardup, packing, secrets
from weftgraph.session import stash

#: What the stages decide by: words of a shingle and percent of similarity, and tokens in a sequence.
SHINGLE, PERCENT, CAPACITY = 5, 80, 2048


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), those with too few n-grams that the model knows, and
    those whose best kernel score is under that of any training text."""
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return neardup.keep_one(docs, SHINGLE, PERCENT)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts: owner-specific ones and widely copied examples by marks of their own."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources weigh as the square roots of their sizes, in one global order."""
    return mixing.mix_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents, copies included, into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [("language_id", identify), ("minhash_dedup", deduplicate), ("secret_redaction", redact), ("source_mixing", mix), ("sequence_packing", pack)]

#: Kernel scores, signatures and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
