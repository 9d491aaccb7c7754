"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a binary trie self-join.

The trie over the distinct fingerprints is cut at ``depth`` bits. Every pair of subtries whose prefixes differ in at most
``radius`` bits is one unit of work; a fingerprint is sent to the units of its subtrie. Within a unit, pairs of trie nodes
are walked down together, bit by bit: the bits in which the two nodes differ add up, and a pair is dropped as soon as they
exceed the radius. A trie node is a range of a sorted array, so a step down is a binary search. What a unit finds leaves it
as a forest, never as all pairs; components are then found over the forests of all units.

Defined results: null text counts as empty; a text without words has fingerprint 0 and is linked like any other. Fewer
words than a shingle form one shingle. Rows that share a doc_id are kept as they are. Components are numbered by their
smallest doc_id; null ids are passed over in that choice, and a component of null ids only has a null number. An empty table
gives an empty one. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrecords.llm.common import importable, stored, table
from docrecords.llm.components import components

SEED = 42
BITS = 64
# fingerprints that one unit should hold, and node pairs that one step looks at
UNIT = 1 << 13
LARGEST = 1 << 19
STEP = 1 << 18
# shingles of a text that are summed at a time
BLOCK = 1 << 15


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the shingles of ``size`` words; bytes.lower and bytes.split know ASCII only, as wanted."""
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(size))))
    hashes = [xxhash.xxh64_intdigest(p, SEED) for p in parts]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, size))


def fingerprint_of(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        octets = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``, fp as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    importable(docs.sparkSession)
    pair = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pair.schema["doc_id"].dataType.simpleString()
    return pair.mapInArrow(each, f"doc_id {kind}, fp long")


def near_prefixes(depth: int, radius: int) -> list[int]:
    """Differences of up to ``radius`` bits between two prefixes of ``depth`` bits."""
    found = {0}
    for _ in range(min(radius, depth)):
        found |= {x ^ (1 << b) for x in found for b in range(depth)}
    return sorted(found)


def trie_pairs(left: np.ndarray, right: np.ndarray, depth: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs of fingerprints within ``radius``; both arrays sorted, unsigned and distinct.

    A state is a pair of nodes: ranges [a0, a1) of left and [b0, b1) of right that each share their first ``at`` bits, and
    the number of bits in which these differ. States wait on a stack in blocks, so memory stays bounded.
    """
    if not len(left) or not len(right):
        return
    spent = int(left[0] >> np.uint64(BITS - depth) ^ right[0] >> np.uint64(BITS - depth)).bit_count() if depth else 0
    same = left is right
    first = [np.array([x]) for x in (0, len(left), 0, len(right), spent)]
    stack = [(depth, *first)]
    while stack:
        at, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > STEP:
            half = len(a0) // 2
            stack.append((at, *(x[half:] for x in (a0, a1, b0, b1, diff))))
            a0, a1, b0, b1, diff = (x[:half] for x in (a0, a1, b0, b1, diff))
            stack.append((at, a0, a1, b0, b1, diff))
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(left[i] ^ right[j]) <= radius
            near &= (i < j) if same else True
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, diff = (x[~leaf] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - at)
        am = split(left, a0, a1, bit)
        bm = split(right, b0, b1, bit)
        children = []
        for x0, x1, xs in ((a0, am, 0), (am, a1, 1)):
            for y0, y1, ys in ((b0, bm, 0), (bm, b1, 1)):
                d = diff + (xs != ys)
                keep = (x0 < x1) & (y0 < y1) & (d <= radius)
                if same:  # each pair of nodes once
                    keep &= x0 <= y0
                children.append([v[keep] for v in (x0, x1, y0, y1, d)])
        joined = [np.concatenate(x) for x in zip(*children)]
        if len(joined[0]):
            stack.append((at + 1, *joined))


def split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the second child of each node begins: the first value of the range with ``bit`` set."""
    start = values[lo]
    pivot = (start | bit) & ~(bit - np.uint64(1))  # the node's prefix, then 1, then zeros
    return np.clip(np.searchsorted(values, pivot), lo, hi)


def forest(links: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Smallest index linked with each of ``n`` nodes, directly or not."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def unit_work(depth: int, radius: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def work(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return unit_links(key, group, depth, radius)

    return work


def unit_links(key: tuple, group: pd.DataFrame, depth: int, radius: int) -> pd.DataFrame:
    """Forest of one pair of subtries."""
    fps = np.unique(group["fp"].to_numpy().view(np.uint64))
    if key[0] == key[1]:
        left = right = fps
        base = 0
        nodes = fps
    else:
        low = fps >> np.uint64(BITS - depth) == np.uint64(key[0])
        left, right, base = fps[low], fps[~low], int(low.sum())
        nodes = np.concatenate([left, right])
    root = forest(((i, j + base) for i, j in trie_pairs(left, right, depth, radius)), len(nodes))
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[linked].view(np.int64), "b": nodes[root[linked]].view(np.int64)})


def near_links(fps: DataFrame, radius: int, unit: int = UNIT, largest: int = LARGEST) -> DataFrame:
    """Links ``(a, b)`` between the distinct ``fp`` of ``fps`` that give the components of all pairs within ``radius``.

    Units of more than ``largest`` fingerprints are cut again, further down the trie, until none is left.
    """
    depth = min(20, max(1, (fps.count() // unit).bit_length()))
    links, cut, above = None, None, 0
    while True:
        near = F.array(*[F.lit(x).cast("long") for x in near_prefixes(depth, radius)])
        prefix = F.shiftrightunsigned("fp", BITS - depth)
        units = fps.select("fp", prefix.alias("p")).select("fp", "p", F.explode(near).alias("x"))
        other = F.col("p").bitwiseXOR(F.col("x"))
        units = units.select("fp", F.least("p", other).alias("lo"), F.greatest("p", other).alias("hi"))
        if cut is not None:
            inside = (F.shiftrightunsigned("lo", depth - above) == F.col("_lo")) & (F.shiftrightunsigned("hi", depth - above) == F.col("_hi"))
            units = units.join(cut, inside, "left_semi")
        crowded = units.groupBy("lo", "hi").count().filter(F.col("count") > largest).select("lo", "hi")
        crowded = stored(crowded, "crowded")
        more = depth < BITS - 8 and not crowded.isEmpty()
        whole = units.join(crowded, ["lo", "hi"], "left_anti") if more else units

        found = whole.groupBy("lo", "hi").applyInPandas(unit_work(depth, radius), "a long, b long")
        links = found if links is None else links.unionByName(found)
        if not more:
            return links
        above, depth = depth, min(depth + 6, BITS - 8)
        cut = crowded.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    each = stored(fingerprints(docs, size, doc_id, text), "fingerprints")
    distinct = stored(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = stored(components(near_links(distinct, radius)), "components")
    member = distinct.join(found, distinct["fp"] == found["node"], "left")
    member = member.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # components of one fingerprint need no second look
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = member.join(smallest, "root").select("fp", "component_id")
    return each.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 2, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the document with the smallest id, and of rows that share this id the first by text. Rows without
    an id cannot be told apart and stay."""
    return one_of_each(docs, near_duplicates(docs, radius, size, doc_id, text), doc_id, text)


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay by ``found(doc_id, component_id)``."""
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_n_id")).distinct()
    kept = docs.join(gone, F.col(doc_id) == F.col("_n_id"), "left_anti")
    several = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_n_id")).count().filter("count > 1").select("_n_id")
    several = stored(several, "repeated-ids")
    if several.isEmpty():
        return kept
    # only rows of repeated ids are ranked
    again = kept.join(several, F.col(doc_id) == F.col("_n_id"), "left_semi")
    rank = F.row_number().over(Window.partitionBy(doc_id).orderBy(text))
    first = again.withColumn("_n_rank", rank).filter("_n_rank = 1").drop("_n_rank")
    return kept.join(several, F.col(doc_id) == F.col("_n_id"), "left_anti").unionByName(first)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
