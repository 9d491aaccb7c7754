"""Lookups over the index table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrecords.spec import LEVELS

# Columns that are searched and columns that are shown.
SEARCHABLE = (
    [f"hierarchy_radio_{name}" for name in LEVELS[:6]]
    + [f"hierarchy_{name}" for name in LEVELS]
    + ["content", "objectID", "page_rank", "level", "position", "lang"]
)
DISPLAYED = (
    [f"hierarchy_radio_{name}" for name in LEVELS[:6]]
    + [f"hierarchy_{name}" for name in LEVELS]
    + ["anchor", "url", "content", "objectID", "lang"]
)
TEXT_COLUMNS = [f"hierarchy_{name}" for name in LEVELS] + ["content"]


def ranking() -> list[Column]:
    """Best first: page rank, level, early position; the id breaks ties."""
    return [F.col("page_rank").desc(), F.col("level").desc(), F.col("position").asc(), F.col("objectID").asc()]


def ids_with_prefix(docs: DataFrame, prefix: str) -> DataFrame:
    return docs.filter(F.startswith("url", F.lit(prefix))).select("objectID")


def top_hits(docs: DataFrame, k: int) -> DataFrame:
    return docs.orderBy(*ranking()).limit(k)


def distinct_by_url(docs: DataFrame, url: str = "url") -> DataFrame:
    """Best hit per URL. The rank filter runs before the shuffle too, so a frequent URL sends one row per task."""
    w = Window.partitionBy(url).orderBy(*ranking())
    return docs.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def searchable(docs: DataFrame) -> DataFrame:
    return _columns(docs, SEARCHABLE)


def displayed(docs: DataFrame) -> DataFrame:
    return _columns(docs, DISPLAYED)


def _columns(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    have = set(docs.columns)
    return docs.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in names])


def with_words(docs: DataFrame, query: str, columns: Sequence[str] = tuple(TEXT_COLUMNS)) -> DataFrame:
    """Documents that contain all words of the query, whatever their case. A plain filter, no shuffle."""
    have = set(docs.columns)
    text = F.lower(F.concat_ws(" ", *[c for c in columns if c in have]))
    between = r"[^\p{L}\p{N}]+"
    # the query is cut and lowered like the text
    words = F.filter(F.split(F.lower(F.lit(query)), between), lambda w: w != "")
    # a word cannot be a token unless it occurs in the text, which is much cheaper to test
    docs = docs.filter(F.forall(words, lambda w: F.contains(text, w)))
    return docs.filter(F.size(F.array_except(words, F.split(text, between))) == 0)


def search(docs: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Matching documents, one per URL, best first."""
    return displayed(top_hits(distinct_by_url(with_words(docs, query)), k))
