"""Keyword search by a stored posting table instead of a scan of all texts.

``build`` cuts the searchable text of every document into words once (as ``lookup.with_words`` does: lower case, pieces
between non-letters and non-digits) and writes two tables in the shared folder:

* ``postings`` (bucket, term, key): one row per distinct word of a document, stored by ``bucket`` = hash of the term in
  folders of their own, and within them sorted by (term, key) after a range partitioning, so that a frequent term spans
  several files, each a range of keys, and a rare one is a few rows of one file;
* ``terms`` (bucket, term, df): the number of documents per term.

``with_all_words`` looks the query's words up in ``terms`` (a few rows), stops at once when one is missing, then reads
the postings of the rarest word (its bucket folder only, the term pushed to the reader) and narrows them by a semi join
with the postings of each next word in rising df, so that the smallest set is carried. Documents are fetched by key at
the end.

Defined results: null or empty text has no words; a document with a null key has no postings and is never found by a
query with words; a query without words matches every document (as a plain filter does); documents that share a key
pool their words, and all are returned when the key matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.operators.lookup import TEXT_COLUMNS
from docrecords.operators.storage import checkpoint_dir

BETWEEN = r"[^\p{L}\p{N}]+"
#: folders that the terms are hashed into
BUCKETS = 64


@dataclass(frozen=True)
class Postings:
    folder: str
    key: str

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/postings")

    def terms(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/terms")


def words_of(text: F.Column) -> F.Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != ""))


def bucket_of(term: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, key: str = "objectID", columns: Sequence[str] = tuple(TEXT_COLUMNS), folder: str | None = None) -> Postings:
    """Write the posting and term tables of ``docs``; the folder defaults to a new one in the shared checkpoint folder."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}"
    have = set(docs.columns)
    text = F.concat_ws(" ", *[F.col(c) for c in columns if c in have])
    pairs = docs.select(F.col(key).alias("key"), F.explode(words_of(text)).alias("term")).filter(F.col("key").isNotNull()).distinct()
    pairs = pairs.withColumn("bucket", bucket_of(F.col("term")))
    (
        pairs.repartitionByRange("bucket", "term", "key")
        .sortWithinPartitions("bucket", "term", "key")
        .write.partitionBy("bucket")
        .parquet(f"{folder}/postings")
    )
    stored = spark.read.parquet(f"{folder}/postings")
    stored.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).write.partitionBy("bucket").parquet(f"{folder}/terms")
    return Postings(folder, key)


def matching_keys(index: Postings, spark: SparkSession, query: str) -> DataFrame | None:
    """Keys of the documents holding every word of ``query``; None when the query has no words."""
    # cut in the JVM like the texts
    words = sorted(spark.range(1).select(words_of(F.lit(query)).alias("w")).first()["w"])
    if not words:
        return None
    buckets = spark.range(1).select(*[bucket_of(F.lit(w)).alias(f"b{i}") for i, w in enumerate(words)]).first()
    wanted = [(w, buckets[i]) for i, w in enumerate(words)]
    terms = index.terms(spark)
    found = {}
    for word, bucket in wanted:
        row = terms.filter((F.col("bucket") == bucket) & (F.col("term") == word)).select("df").first()
        if row is None:
            return spark.createDataFrame([], "key string")
        found[word] = (row["df"], bucket)
    order = sorted(found, key=lambda w: (found[w][0], w))
    postings = index.postings(spark)

    def of(word: str) -> DataFrame:
        return postings.filter((F.col("bucket") == found[word][1]) & (F.col("term") == word)).select("key")

    keys = of(order[0])
    for word in order[1:]:
        keys = keys.join(of(word), "key", "left_semi")
    return keys


def with_all_words(docs: DataFrame, index: Postings, query: str) -> DataFrame:
    """Documents of ``docs`` that hold every word of ``query``, found by the postings alone."""
    keys = matching_keys(index, docs.sparkSession, query)
    if keys is None:
        return docs
    return docs.join(keys.withColumnRenamed("key", index.key), index.key, "left_semi")
