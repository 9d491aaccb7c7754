"""Mixing documents to target weights with soft domain membership.

A softmax classifier over hashed words, fitted to a table of labelled documents, gives every document a posterior over
domains. A document at rate ``r`` is expected to bring ``r * tokens * posterior[k]`` tokens to domain ``k``. Rates between 0
and ``most`` are fitted by least squares so that the expected totals meet the targets: projected gradient steps from rate 1.

Each step is one sum over all documents, of as many numbers as there are domains. In the metric that weighs a document by
its tokens and domains by the inverse of their Gram matrix, the step of length 1 is ``r <- clip(r - posterior . g)`` with
one ``g`` for all. Steps go on until the token shares reached are within ``close`` of the target shares (summed over
domains), or until a step moves the totals by less than that (the least-squares fit is reached while targets stay out of
reach), or after ``steps`` steps; ``fit_rates`` returns what was asked, what is reachable and what the fit reached, so a
caller can see the gap. No step reads a text again. Documents are then taken ``floor(rate + u)`` times with ``u`` uniform
from a hash of their id: unbiased, the expected count is the rate.

The targets are shares of tokens. The total is set by one domain, the anchor, which is used whole (``most`` times). A domain
that has fewer tokens than its share is used whole too; no other one is thinned out for it.

``mixed`` computes posterior, rate and copies in one pass over the documents, beside their columns: no text is shuffled.

Defined results: null text counts as empty, has no tokens and rate 1. Without labelled rows all domains are equally likely.
Rows that share an id each get the copies of their own text; equal rows get equal numbers. A null id is hashed as null.
An empty table gives an empty one. Extra columns stay; working columns start with ``_m_``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from docrecords.llm import hashed
from docrecords.llm.common import importable, stored, table

GROUP = 128


@dataclass(frozen=True)
class Mixing:
    """``rows``: labelled documents that the classifier is fitted to, at most; the first by hash of their id."""

    domains: tuple[str, ...] = ("good", "low", "toxic")
    targets: tuple[float, ...] = (0.94, 0.03, 0.03)
    anchor: str = "good"
    buckets: int = 1 << 12
    rows: int = 12_000
    epochs: int = 4
    least_updates: int = 400
    batch: int = 128
    rate: float = 0.03
    most: float = 1.0
    steps: int = 100
    close: float = 1e-3


def label_domain() -> Column:
    """Domain of a row of ``labels``: toxic before low quality before good."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")


def inputs(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Presence of hashed words with byte-class shares, and the number of words."""
    words, classes = hashed.counts(texts, buckets)
    x = np.concatenate([(words > 0).astype(np.float32) * np.float32(0.25), 4 * hashed.shape(words, classes)], axis=1)
    return x, words.sum(axis=1)


def fit_softmax(x: np.ndarray, y: np.ndarray, mixing: Mixing) -> np.ndarray:
    """Weights ``(inputs + 1, domains)``, the last row the bias; Adam, fixed order."""
    rng, k = np.random.default_rng(11), len(mixing.domains)
    w = np.zeros((x.shape[1] + 1, k), np.float32)
    first, second, step = np.zeros_like(w), np.zeros_like(w), 0
    hot = np.eye(k, dtype=np.float32)[y]
    # few rows are seen more often
    for _ in range(max(mixing.epochs, -(-mixing.least_updates * mixing.batch // len(y))) if len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), mixing.batch):
            rows, step = order[at : at + mixing.batch], step + 1
            error = (softmax(x[rows], w) - hot[rows]).astype(np.float32) / len(rows)
            g = np.vstack([x[rows].T @ error, error.sum(axis=0)]) + np.float32(1e-5) * w
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            w -= mixing.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


def softmax(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = (x @ w[:-1] + w[-1]).astype(np.float64)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, domain: Column, mixing: Mixing) -> np.ndarray:
    known = labels.select(F.col("doc_id").alias("_m_id"), domain.alias("_m_domain"))
    known = known.filter("_m_id is not null").filter(F.col("_m_domain").isin(*mixing.domains))
    known = known.orderBy(F.xxhash64("_m_id"), "_m_id", "_m_domain").limit(mixing.rows)
    rows = docs.select(F.col("doc_id").alias("_m_id"), "text").join(F.broadcast(known), "_m_id")
    width = mixing.buckets + hashed.SHAPES

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                x, _ = inputs(batch.column(1), mixing.buckets)
                used = [np.flatnonzero(r) for r in x]
                at = pa.array([u.astype(np.int32).tobytes() for u in used], pa.binary())
                value = pa.array([r[u].tobytes() for r, u in zip(x, used)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), at, value], names=["id", "domain", "at", "value"])

    importable(docs.sparkSession)
    found = rows.mapInArrow(each, "id long, domain string, at binary, value binary").toArrow()
    found = found.sort_by([("id", "ascending"), ("domain", "ascending")])
    x = np.zeros((found.num_rows, width), np.float32)
    for r, (at, value) in enumerate(zip(found["at"], found["value"])):
        x[r, np.frombuffer(at.as_py(), np.int32)] = np.frombuffer(value.as_py(), np.float32)
    y = np.array([mixing.domains.index(d) for d in found["domain"].to_pylist()], np.int64)
    return fit_softmax(x, y, mixing)


def with_posteriors(docs: DataFrame, weights: np.ndarray, mixing: Mixing, tokens: str = "_m_tokens", p: str = "_m_p") -> DataFrame:
    """``docs`` with the tokens of each text and its posterior, rounded to 6 places, as two more columns."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    text = docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                x, n = inputs(batch.column(text), mixing.buckets)
                q = np.round(softmax(x, sent.value), 6)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(q.ravel(), pa.float64()), q.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), lists], names=[*batch.schema.names, tokens, p])

    importable(docs.sparkSession)
    return docs.mapInArrow(each, StructType([*docs.schema.fields, StructField(tokens, LongType()), StructField(p, ArrayType(DoubleType()))]))


def posteriors(docs: DataFrame, weights: np.ndarray, mixing: Mixing) -> DataFrame:
    """``(doc_id, tokens, p)`` of every row, p rounded to 6 places."""
    return with_posteriors(docs.select("doc_id", "text"), weights, mixing, "tokens", "p").select("doc_id", "tokens", "p")


def rate_after(steps: Sequence[np.ndarray], most: float, p: str = "p") -> Column:
    """The rate after the given gradient steps, from rate 1."""
    rate = F.lit(1.0)
    for g in steps:
        move = sum(F.get(p, F.lit(k)) * F.lit(float(v)) for k, v in enumerate(g))
        rate = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), rate - move))
    return rate


def totals(each: DataFrame, rate: Column, k: int) -> np.ndarray:
    """Expected tokens by domain at the given rates."""
    row = each.select("tokens", "p", rate.alias("r")).agg(*[F.sum(F.col("r") * F.col("tokens") * F.get("p", F.lit(i))).alias(f"t{i}") for i in range(k)])
    return np.array([v or 0.0 for v in row.first()])


def wanted(have: np.ndarray, mixing: Mixing) -> np.ndarray:
    """Target totals: the shares of the total at which the anchor is used ``most`` times; a domain that has less than its
    share is used as often as all of it allows."""
    share, anchor = np.array(mixing.targets), mixing.domains.index(mixing.anchor)
    total = mixing.most * have[anchor] / share[anchor]
    return np.minimum(share * total, mixing.most * have)


def shares(totals: np.ndarray) -> np.ndarray:
    return totals / max(totals.sum(), 1e-12)


def fit_rates(each: DataFrame, mixing: Mixing) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Gradient steps, the targets (the shares asked of the tokens there are, lowered where a domain has too few), and the
    totals reached, by domain."""
    k = len(mixing.domains)
    have = totals(each, F.lit(1.0), k)
    target = wanted(have, mixing)
    grams = [F.sum(F.col("tokens") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]
    gram = np.array([v or 0.0 for v in each.agg(*grams).first()]).reshape(k, k)
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    steps: list[np.ndarray] = []
    reached = have
    for _ in range(mixing.steps):
        if np.abs(shares(reached) - shares(target)).sum() <= mixing.close:
            break
        steps.append(np.round(inverse @ (reached - target), 9))
        before, reached = reached, totals(each, rate_after(steps, mixing.most), k)
        if np.abs(reached - before).sum() <= mixing.close * max(target.sum(), 1.0):
            break
    return steps, target, reached


def rate(steps: Sequence[np.ndarray], mixing: Mixing, tokens: str = "tokens", p: str = "p") -> Column:
    """The fitted rate of a row, rounded to 6 places; 1 for rows without tokens."""
    return F.round(F.when(F.col(tokens) > 0, rate_after(steps, mixing.most, p)).otherwise(1.0), 6)


def copies(rate: Column, doc_id: Column) -> Column:
    """How often a document is taken: the rate, rounded up with the chance of its fraction, by a hash of the id."""
    u = F.pmod(F.xxhash64(F.lit("mixing"), doc_id), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return F.floor(rate + u).cast("int")


def fitted(docs: DataFrame, labels: DataFrame, domain: Column | None, mixing: Mixing) -> tuple[np.ndarray, list[np.ndarray]]:
    """Classifier weights and rate steps; the posteriors that the fit sums are stored once, without texts."""
    weights = train(docs, labels, label_domain() if domain is None else domain, mixing)
    each = stored(posteriors(docs, weights, mixing), "posteriors")
    steps, _, _ = fit_rates(each, mixing)
    return weights, steps


def rates(docs: DataFrame, labels: DataFrame, domain: Column | None = None, mixing: Mixing = Mixing()) -> DataFrame:
    """``(doc_id, tokens, p, rate, copies)`` for every row."""
    weights, steps = fitted(docs, labels, domain, mixing)
    out = posteriors(docs, weights, mixing).withColumn("rate", rate(steps, mixing))
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def mixed(docs: DataFrame, labels: DataFrame, domain: Column | None = None, mixing: Mixing = Mixing()) -> DataFrame:
    """``docs`` with every document as often as its rate says: posterior, rate and copies in one pass beside the columns."""
    weights, steps = fitted(docs, labels, domain, mixing)
    out = with_posteriors(docs, weights, mixing)
    times = copies(rate(steps, mixing, "_m_tokens", "_m_p"), F.col("doc_id"))
    out = out.withColumn("_m_copies", times).filter("_m_copies > 0")
    out = out.withColumn("_m_n", F.explode(F.array_repeat(F.lit(1), F.col("_m_copies"))))
    return out.select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixing = Mixing()
    out = rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mixing=mixing)
    shares = [F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(mixing.domains)]
    return out.select("doc_id", F.col("tokens").alias("n_tokens"), *shares, "rate", "copies")
