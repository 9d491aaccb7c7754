"""Near-duplicates by Jaccard similarity of word shingles: banded minima propose, SimHash and the exact sets decide.

Two texts of similarity 0.8 differ in about 10 of 64 SimHash bits, so a trie over fingerprints would have to walk almost all
pairs. Candidates come from bands instead: ``BANDS`` keys, each of the minima of ``ROWS`` permutations of the shingle hashes.
Two texts of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8. Candidates within ``RADIUS``
bits of SimHash are compared by their whole shingle sets, and only pairs of at least the wanted similarity are linked.

Texts with equal sets are one node. In a first round each node is compared with the smallest node of each of its keys. What
these links join need not be compared again; all other pairs of a key are compared in the second round, so no pair that
shares a key is passed over unless its two texts are in one component already.

Defined results as in ``simhash``: null text counts as empty, texts without words are alike, components are numbered by their
smallest doc_id. Nodes are 64-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecords.llm.common import importable, stored
from docrecords.llm.components import components
from docrecords.llm.simhash import fingerprint_of, one_of_each, shingle_hashes

BANDS, ROWS = 20, 5
RADIUS = 24
# shingles whose permutations are looked at at a time
BLOCK = 1 << 12
MULTIPLIERS = np.random.default_rng(5).integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> list[int]:
    """Signed 64-bit keys of the bands of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        least = np.minimum(least, (shingles[at : at + BLOCK] * MULTIPLIERS).min(axis=1))
    return [signed(xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sketches(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, node, fp, bands)`` of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py(), size)
                unique = np.unique(hashes)
                rows.append((signed(xxhash.xxh64_intdigest(unique.tobytes())), signed(fingerprint_of(hashes)), band_keys(unique)))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
            made = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "text", "node", "fp", "bands"])

    importable(docs.sparkSession)
    pair = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pair.schema["doc_id"].dataType.simpleString()
    return pair.mapInArrow(each, f"doc_id {kind}, text string, node long, fp long, bands array<long>")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets, both sorted and distinct; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def verified(pairs: DataFrame, each: DataFrame, share: float, size: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets have at least similarity ``share``."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, text_a, text_b in zip(*batch.columns):
                a = a.as_py()
                if a != last:
                    last, mine = a, np.unique(shingle_hashes(text_a.as_py(), size))
                if jaccard(mine, np.unique(shingle_hashes(text_b.as_py(), size))) >= share:
                    found.append((a, b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))], names=["a", "b"])

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # all texts of a node have the same set
    texts = each.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts, "alike-texts")
    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in ("a", "b"))
    both = pairs.join(right, "b").join(left, "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(alike, "a long, b long")


def near(x: Column, y: Column, radius: int) -> Column:
    return F.bit_count(x.bitwiseXOR(y)) <= radius


def alike(docs: DataFrame, share: float = 0.8, size: int = 5, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs``."""
    each = stored(sketches(docs, size, doc_id, text), "sketches")
    nodes = each.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = stored(nodes, "nodes")
    bands = nodes.select(F.explode("bands").alias("key"), "node", "fp")
    least = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "fp")).alias("least")).filter("n > 1")
    shared = stored(bands.join(least.select("key", "least"), "key"), "shared-keys")

    star = shared.filter(F.col("node") != F.col("least.node")).filter(near(F.col("fp"), F.col("least.fp"), radius))
    star = stored(star.select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct(), "alike-star")
    links = stored(verified(star, each, share, size), "alike-links")
    roots = stored(components(links), "alike-roots").withColumnRenamed("node", "_node")

    member = shared.join(roots, F.col("node") == F.col("_node"), "left").select("key", "node", "fp", F.coalesce("root", "node").alias("root"))
    member = stored(member, "alike-members")
    apart = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    x = member.join(apart, "key", "left_semi")
    y = x.select(F.col("key").alias("_key"), F.col("node").alias("_node"), F.col("fp").alias("_fp"), F.col("root").alias("_root"))
    rest = x.join(y, (F.col("key") == F.col("_key")) & (F.col("root") < F.col("_root")) & near(F.col("fp"), F.col("_fp"), radius))
    rest = rest.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()
    rest = stored(rest.join(star, ["a", "b"], "left_anti"), "alike-rest")
    more = stored(verified(rest, each, share, size), "alike-links")
    if not more.isEmpty():
        roots = stored(components(links.unionByName(more)), "alike-roots").withColumnRenamed("node", "_node")

    root = nodes.select("node", "first").join(roots, F.col("node") == F.col("_node"), "left")
    root = root.select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = root.groupBy("root").agg(F.min("first").alias("component_id"))
    by_node = root.join(smallest, "root").select("node", "component_id")
    return each.select("doc_id", "node").join(by_node, "node").select("doc_id", "component_id")


def keep_one_alike(docs: DataFrame, share: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the document with the smallest id, as ``simhash.keep_one``."""
    return one_of_each(docs, alike(docs, share, size, doc_id=doc_id, text=text), doc_id, text)
