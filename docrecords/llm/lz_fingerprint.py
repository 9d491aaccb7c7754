"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases: each is the shortest piece that was not a phrase before. The phrases are hashed, and the
fingerprint is the ``KEPT`` smallest hashes. The likeness of two fingerprints estimates how many phrases the texts share, of
all they have: among the smallest hashes of both together, the share that both have. Texts with few phrases are compared by
all of them.

Every document is compared with a changed version of itself, whose tail is the head of the next document, and with the next
document, by ascending id. To bring neighbours together without gathering a text twice, ids are cut into ranges with about
as many rows each; a range gets its own documents and a copy of the first one that follows it. One shuffle moves each text
once. Within a range documents are read in order, two at a time.

Defined results: null text counts as empty. Two empty texts have likeness 1, an empty one and another 0. Rows that share an
id follow each other by text; null ids come first. A single document is its own next one. An empty table gives an empty one.
Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.llm.common import importable, partitions, table

KEPT = 128
# ranges for each partition; more make partitions more alike
RANGES = 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def parse(text: str, seen: set[str], open_: str = "") -> str:
    """Adds the phrases of ``text`` to ``seen``; ``open_`` is the phrase begun before. Returns the phrase left open."""
    add = seen.add
    for char in text:
        open_ += char
        if open_ not in seen:
            add(open_)
            open_ = ""
    return open_


def smallest(phrases: set[str]) -> np.ndarray:
    """The smallest hashes of the phrases, sorted. A phrase left open at the end is one of them already."""
    raw = np.fromiter(map(crc32, map(str.encode, phrases)), np.uint64, len(phrases))
    mixed = raw * _MIX
    mixed = np.unique((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(32))
    return mixed[:KEPT]


def fingerprints(text: str, tail: str) -> tuple[np.ndarray, str, np.ndarray]:
    """Fingerprint of ``text``, the changed text, and its fingerprint. Both share the parse of their common head.

    The last half of the code points, rounded down, gives way to ``tail``.
    """
    head = text[: len(text) - len(text) // 2]
    seen: set[str] = set()
    open_ = parse(head, seen)
    other = set(seen)
    parse(text[len(head) :], seen, open_)
    parse(tail, other, open_)
    return smallest(seen), head + tail, smallest(other)


def fingerprint(text: str) -> np.ndarray:
    seen: set[str] = set()
    parse(text, seen)
    return smallest(seen)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the shared part of two phrase sets from their smallest hashes."""
    both = np.union1d(a, b)[: KEPT]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(both)


def text_of(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def constant(values: list, kind: str) -> Column:
    """A long array of numbers as a constant of the plan; the optimizer folds the expression."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def range_of(id_: Column, cuts: Column, n: int) -> Column:
    """How many of the ``n`` sorted cuts are at most the id, by binary search; null is in the first range."""
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)] if n else []

    def up(at: Column, step: Column) -> Column:
        fits = (at + step <= n) & (F.get(cuts, at + step - 1) <= id_)
        return F.when(fits, at + step).otherwise(at)

    return F.aggregate(constant(steps, "int"), F.lit(0), up)


def in_ranges(docs: DataFrame) -> DataFrame:
    """``(r, copy, id, text)``: rows by range, and for each range a copy of the row that follows it.

    The cuts, and the ids that begin ranges, are as many as ranges, whatever the rows.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = RANGES * partitions(docs.sparkSession)
    places = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = sorted(set(rows.agg(F.percentile_approx("id", places, 10 * n)).first()[0] or []))
    kind = docs.schema["doc_id"].dataType.simpleString()
    located = rows.withColumn("r", range_of(F.col("id"), constant(cuts, kind), len(cuts)))
    begins = located.groupBy("r").agg(F.min(F.struct("id")).alias("s")).orderBy("r").collect()  # null is smallest
    first = {row["r"]: row["s"]["id"] for row in begins}
    numbers = sorted(first)
    before = {r: numbers[i - 1] for i, r in enumerate(numbers)}
    size = max(numbers, default=-1) + 1
    begin = F.get(constant([first.get(r) or 0 for r in range(size)], kind), F.col("r"))
    if numbers and first[numbers[0]] is None:
        begin = F.when(F.col("r") != numbers[0], begin)
    target = F.get(constant([before.get(r, 0) for r in range(size)], "int"), F.col("r"))
    here = F.struct(F.col("r").alias("r"), F.lit(False).alias("copy"))
    there = F.struct(target.alias("r"), F.lit(True).alias("copy"))
    both = F.when(F.col("id").eqNullSafe(begin), F.array(here, there)).otherwise(F.array(here))
    spread = located.withColumn("to", F.explode(both)).select("to.r", "to.copy", "id", "text")
    return spread.repartition(partitions(docs.sparkSession), "r").sortWithinPartitions("r", "copy", "id", "text")


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def each_with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order, each with the row after it. A fingerprint is computed once, and once more where a range ends."""
    done: list[tuple] = []
    own = None  # the row whose next one comes now, and what waits for that one's fingerprint
    waiting = None
    for batch in batches:
        for r, copy, id_, text in zip(*(c.to_pylist() for c in batch.columns)):
            if own is not None and own[0] == r:
                mine, edited, changed = fingerprints(own[2], text[: len(own[2]) // 2])
                if waiting is not None:
                    done.append((*waiting[0], likeness(waiting[1], mine)))
                digest = sha256(edited.encode()).hexdigest()
                waiting = (own[1], len(own[2]), digest, text_of(mine), text_of(changed), likeness(mine, changed)), mine
                if copy:
                    done.append((*waiting[0], likeness(mine, fingerprint(text))))
                    waiting = None
            # copies after the first are equal ids with later texts
            own = None if copy else (r, id_, text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=list(NAMES))
            done = []


def lz_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, with the columns ``NAMES``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    importable(docs.sparkSession)
    return in_ranges(docs).mapInArrow(each_with_next, schema)


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprints(table(spark, sf_dir, "documents"))
