"""From raw documents to mixed, clean, tokenized text: the operators of ``docrecords.llm`` in sequence.

Each stage takes the documents that the one before it kept and returns documents with the same columns; the last adds token
ids. ``run`` writes every result but the last to the shared folder before the next stage starts, so a stage whose executors
are lost begins again from stored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docrecords.llm import mixing, pii, quality_rules, sentencepiece_stream, simhash
from docrecords.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id (the binary trie self-join of op10)."""
    return simhash.keep_one(docs, radius=RADIUS, size=SHINGLE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the name of their kind; ``n_chars`` follows the text."""
    return pii.redacted(docs, n_chars="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their fitted rates say."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return sentencepiece_stream.with_ids(docs)


# the SimHash contract: words of a shingle, and most differing bits of linked fingerprints
SHINGLE = 3
RADIUS = 2

STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing", mix),
    ("SentencePiece", tokens),
]

# hashes, boosted trees and a tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
