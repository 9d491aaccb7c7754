"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

``score = sigmoid(bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``. The pairwise sum is taken in linear time as
``(|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2``. Words are the row's bucket counts at length one; statistics and the
metadata follow as further inputs. The model is fitted to at most ``Machine.rows`` labelled documents, the first by hash of
their id, whose inputs come to the driver (a few kilobytes each). All documents are scored where they are read.

Defined results: null text counts as empty and gets a score like any other; null metadata count as 0. Without labels, or
with labels of one kind, the score is the share of label 1 seen (0.5 without any). Documents with several labels count once
per label. Repeated rows are scored each. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.llm import hashed
from docrecords.llm.common import importable, is_held_out, table

GROUP = 128


@dataclass(frozen=True)
class Machine:
    buckets: int = 1 << 12
    rank: int = 8
    rows: int = 12_000
    epochs: int = 4
    steps: int = 400
    batch: int = 128
    rate: float = 0.02
    decay: float = 1e-5
    threshold: float = 0.3

    @property
    def width(self) -> int:
        return self.buckets + hashed.SHAPES + 1


@dataclass(frozen=True)
class Fitted:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.linear + 0.5 * ((x @ self.factors) ** 2 - (x * x) @ (self.factors**2)).sum(axis=1)


def inputs(texts: pa.Array, metadata: np.ndarray, machine: Machine) -> np.ndarray:
    words, classes = hashed.counts(texts, machine.buckets)
    x = np.empty((len(texts), machine.width), np.float32)
    norm = np.sqrt((words.astype(np.float64) ** 2).sum(axis=1))
    x[:, : machine.buckets] = words / np.maximum(norm, 1)[:, None]
    x[:, machine.buckets : -1] = hashed.shape(words, classes)
    x[:, -1] = np.log1p(np.maximum(metadata, 0)) / 12
    return x


def fit(x: np.ndarray, y: np.ndarray, machine: Machine) -> Fitted:
    """Logistic loss, Adam, fixed order and start."""
    rng = np.random.default_rng(7)
    share = float(y.mean()) if len(y) else 0.5
    linear = np.zeros(machine.width, np.float32)
    factors = rng.normal(0, 0.01, (machine.width, machine.rank)).astype(np.float32)
    if not len(y) or not 0 < share < 1:
        return Fitted(30.0 * (share - 0.5) * 2 if len(y) else 0.0, linear, factors * 0)
    bias = np.float32(np.log(share / (1 - share)))
    values = [np.array([bias], np.float32), linear, factors]
    first = [np.zeros_like(v) for v in values]
    second = [np.zeros_like(v) for v in values]
    step = 0
    # few rows are seen more often
    for _ in range(max(machine.epochs, -(-machine.steps * machine.batch // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), machine.batch):
            rows = order[at : at + machine.batch]
            xb, step = x[rows], step + 1
            model = Fitted(float(values[0][0]), values[1], values[2])
            error = (1 / (1 + np.exp(-np.clip(model.logits(xb), -30, 30))) - y[rows]).astype(np.float32) / len(rows)
            sums = xb @ values[2]
            grads = [
                np.array([error.sum()], np.float32),
                xb.T @ error + machine.decay * values[1],
                xb.T @ (error[:, None] * sums) - values[2] * ((xb * xb).T @ error)[:, None] + machine.decay * values[2],
            ]
            for v, g, m, s in zip(values, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= machine.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Fitted(float(values[0][0]), values[1], values[2])


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``(_f_id, text, n_chars, _f_y)`` of at most ``rows`` labelled documents that may be learned from."""
    known = labels.select(F.col("doc_id").alias("_f_id"), F.col(label).alias("_f_y")).dropna()
    known = known.filter(~is_held_out(F.col("_f_id"))).orderBy(F.xxhash64("_f_id"), "_f_id", "_f_y").limit(rows)
    return docs.select(F.col("doc_id").alias("_f_id"), "text", metadata(docs)).join(F.broadcast(known), "_f_id")


def metadata(docs: DataFrame) -> Column:
    held = F.col("n_chars") if "n_chars" in docs.columns else F.lit(0)
    return F.coalesce(held.cast("double"), F.lit(0.0)).alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", machine: Machine = Machine()) -> Fitted:
    rows = labelled_rows(docs, labels, label, machine.rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                x = inputs(batch.column(1), batch.column(2).to_numpy(), machine)
                used = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()),
                        batch.column(3).cast(pa.int64()),
                        pa.array([u.astype(np.int32).tobytes() for u in used], pa.binary()),
                        pa.array([r[u].tobytes() for r, u in zip(x, used)], pa.binary()),
                    ],
                    names=["id", "y", "at", "value"],
                )

    importable(rows.sparkSession)
    found = rows.mapInArrow(each, "id long, y long, at binary, value binary").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    x = np.zeros((found.num_rows, machine.width), np.float32)
    for r, (at, value) in enumerate(zip(found["at"], found["value"])):
        x[r, np.frombuffer(at.as_py(), np.int32)] = np.frombuffer(value.as_py(), np.float32)
    return fit(x, (found["y"].to_numpy() > 0).astype(np.float32), machine)


def scored(docs: DataFrame, model: Fitted, machine: Machine = Machine()) -> DataFrame:
    """``(doc_id, score)`` of every row; scores are rounded to 6 places."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                logits = sent.value.logits(inputs(batch.column(1), batch.column(2).to_numpy(), machine))
                score = np.round(1 / (1 + np.exp(-np.clip(logits.astype(np.float64), -30, 30))), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    importable(docs.sparkSession)
    return docs.select("doc_id", "text", metadata(docs)).mapInArrow(each, f"doc_id {kind}, score double")


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, machine = table(spark, sf_dir, "documents"), Machine()
    out = scored(docs, train(docs, table(spark, sf_dir, "labels"), "quality", machine), machine)
    return out.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= machine.threshold).cast("int").alias("predicted")
    )
