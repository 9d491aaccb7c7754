"""Quality rules: counted rules, then a hashed n-gram log-likelihood ratio of trusted and raw text.

Everything here is DataFrame functions. N-grams of a text are its words, its pairs of neighbouring words and the word
endings of three characters, each hashed into one of ``buckets``. One pass counts the buckets over all documents (raw) and over the
trusted ones (target). A document's score is the mean over its n-grams of ``log(p_target / p_raw)``; the target is smoothed
towards the raw distribution, so buckets without evidence count nothing.

Defined results: a null or empty text, or one of blanks only, has no words and fails the base rules. Without trusted rows
every ratio is 0 and the base rules decide alone. Repeated rows are judged each on its own. Extra columns are left out of
``quality_rules`` and kept by ``keep_good``, whose working columns are named ``_q_*``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.llm.common import BLANK, table

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SCALE = 10_000


@dataclass(frozen=True)
class RatioModel:
    """``threshold``: mean log ratio below which a text is rejected."""

    buckets: int = 1 << 15
    smoothing: float = 2_000.0
    threshold: float = -0.3


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{BLANK}+"), lambda w: w != "")


def ngrams(words: Column, buckets: int) -> Column:
    """Bucket numbers of words, of neighbouring words and of word endings; ``words`` is a column, not an expression. The kind
    is hashed too, so kinds do not meet by equal text."""

    def bucket(kind: int, *parts: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(kind), *parts), F.lit(buckets)).cast("int")

    single = F.transform(words, lambda w: bucket(1, w))
    ending = F.transform(words, lambda w: bucket(3, F.substring(w, -3, 3)))
    heads = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    double = F.transform(heads, lambda w, i: bucket(2, w, F.get(words, i + 1)))
    return F.concat(single, double, ending)


def window_hashes(words: Column) -> Column:
    """64-bit hash of each window of three words; ``words`` is a column, not an expression."""
    heads = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(heads, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def covered_words(sorted_windows: Column) -> Column:
    """Words in windows of three which occur twice or more, each counted once.

    Takes a column of (hash, place), sorted. The places of equal neighbours, sorted again, cover 3 words each less what
    the place before covers too.
    """

    def hash_at(i: Column) -> Column:
        return F.get(sorted_windows, i)["h"]

    def equal(a: Column, b: Column) -> Column:
        return F.coalesce(a == b, F.lit(False))

    again = F.filter(sorted_windows, lambda x, j: equal(hash_at(j - 1), x["h"]) | equal(hash_at(j + 1), x["h"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        start,
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_q_words`` and the counted columns, prefixed ``_q_``."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n", -1), lambda x: x.rlike(f"[^{BLANK[1:]}"))
    out = docs.withColumn("_q_words", words_of(F.col(text))).withColumn("_q_lines", lines)
    out = out.withColumn("_q_hashes", window_hashes(F.col("_q_words")))
    places = F.sort_array(F.transform("_q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    unique = F.size(F.array_distinct("_q_hashes")) == F.size("_q_hashes")
    # texts without a repeated window skip the sort
    out = out.withColumn("_q_windows", F.when(~unique, places))
    n = F.size("_q_words").cast("long")
    out = out.withColumns(
        {
            "_q_n_words": n,
            "_q_word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
            "_q_n_symbols": F.length(F.regexp_replace(value, f"[^{SYMBOLS}]++", "")).cast("long"),
            "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_n_repeat_words": F.coalesce(covered_words(F.col("_q_windows")), F.lit(0)),
        }
    )
    failed = (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))
    return out.drop("_q_lines", "_q_hashes", "_q_windows").withColumn("_q_base_failed", failed)


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Ids of all documents marked good."""
    return labels.filter(F.col("quality") == 1).select(F.col(doc_id).alias("_q_id")).filter("_q_id is not null").distinct()


def bucket_counts(docs: DataFrame, trusted: DataFrame, model: RatioModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket, raw, target``: counts over all n-grams of all documents, and of the trusted ones."""
    # both sides are dealt out by id whatever their size, so small and large tables run alike
    marked = docs.select(F.col(doc_id).alias("_q_id"), F.col(text).alias("_q_text")).join(
        trusted.withColumn("_q_good", F.lit(1)).hint("shuffle_hash"), "_q_id", "left"
    )
    marked = marked.select(F.coalesce("_q_good", F.lit(0)).alias("good"), words_of(F.col("_q_text")).alias("words"))
    grams = marked.select("good", F.explode(ngrams(F.col("words"), model.buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))


def bucket_ratios(counts: list, model: RatioModel) -> list[int]:
    """``log(p_target / p_raw)`` by bucket in whole numbers of ``1 / SCALE``, so sums do not depend on their order."""
    raw_total = sum(row["raw"] for row in counts)
    target_total = sum(row["target"] for row in counts)
    ratios = [0] * model.buckets
    if target_total:
        for row in counts:
            p_raw = row["raw"] / raw_total
            p_target = (row["target"] + model.smoothing * p_raw) / (target_total + model.smoothing)
            ratios[row["bucket"]] = round(math.log(p_target / p_raw) * SCALE)
    return ratios


def constant_array(values: list[int]) -> Column:
    """A long array as a constant of the plan; the optimizer folds the expression."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def judged(docs: DataFrame, trusted: DataFrame, model: RatioModel = RatioModel(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_q_*`` columns: base counts, ``_q_ratio`` (rounded to 6 places) and ``_q_kept``."""
    # at most one row per bucket comes to the driver
    weights = constant_array(bucket_ratios(bucket_counts(docs, trusted, model, doc_id, text).collect(), model))
    out = with_base(docs, text).withColumn("_q_grams", ngrams(F.col("_q_words"), model.buckets))
    total = F.aggregate("_q_grams", F.lit(0).cast("long"), lambda acc, b: acc + F.get(weights, b))
    out = out.withColumn("_q_ratio", F.round(F.coalesce(total / F.nullif(F.size("_q_grams") * SCALE, F.lit(0)), F.lit(0.0)), 6))
    kept = ~F.col("_q_base_failed") & (F.col("_q_ratio") >= model.threshold)
    return out.withColumn("_q_kept", kept).drop("_q_words", "_q_grams")


def quality_rules(docs: DataFrame, labels: DataFrame, model: RatioModel = RatioModel()) -> DataFrame:
    """One row per document: counted columns, ``base_failed``, ``kept``, ``ratio``."""
    out = judged(docs, trusted_ids(labels), model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"]
    return out.select("doc_id", *[F.col(f"_q_{n}").alias(n) for n in names])


def keep_good(docs: DataFrame, labels: DataFrame, model: RatioModel = RatioModel()) -> DataFrame:
    """The documents that are kept, with their own columns only."""
    out = judged(docs, trusted_ids(labels), model)
    # a filter would be pushed below the projections and take a copy of all their expressions along
    return out.withColumn("_q_row", F.explode(F.when(F.col("_q_kept"), F.array(F.lit(1))))).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
