"""Removal of passages that repeat across documents, by distributed difference-cover naming.

A passage of ``LENGTH`` bytes is removed where it also starts in a document with a smaller id. Ordering all suffixes would
move every byte many times. A difference cover does with a sample: of the places of a document those are sampled whose
number modulo ``PERIOD`` is in ``COVER``. Whatever two places are compared, there is a shift below the period at which both
are sampled, because every difference modulo the period occurs in the cover.

1. Sample: the words after a sampled place get a name, common to all equal ones. Names are sorted, and adjacent ones that are
   equal show which sampled places have a partner in another document. Places without a sampled partner within reach cannot
   begin a repeated passage.
2. Recursion: the sampled places that are left get longer names, of what every passage that reaches them at a shift of
   one of the ``BANDS`` has in common. A longer name is made of the running names of its two ends, at no more cost.
3. Merge: all places with a partner within reach get the name of their whole passage. Names are sorted, and each is compared
   with the adjacent equal ones: is the smallest document of a name another one?

Only equality of prefixes is asked for here, so names are hashes instead of ranks: 40 bits where a mistake costs time only
(steps 1 and 2), 64 bits and more for the passages themselves. Documents are packed into chunks, and a chunk sends each name once to
the range of names it falls in, as sorted arrays; back comes one bit for each name. So a passage that is everywhere counts
once per chunk, and texts are stored once, by chunk, and never shuffled.

Defined results: null text counts as empty. Texts shorter than a passage lose nothing. Rows that share an id do not remove
from each other; null ids count as the largest. Passages do not cross rows. An empty table gives an empty one. Extra columns
do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.llm.common import importable, partitions, shared_folder, stored, table
from docrecords.llm.hashed import buffers, mixed, powers

LENGTH = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
KEY = LENGTH - PERIOD + 1
BANDS = ((0, 10), (11, 20), (21, 30))
# bytes and rows of a chunk; names that one range should hold
CHUNK, ROWS = 1 << 21, 60_000
NAMES = 1 << 20
NO_ID = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


# ------------------------------------------------------------------------------------------------- chunks


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to chunks: compressed bytes, row ids and sizes."""
    task, seq = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = rows = 0

    def chunk() -> pa.RecordBatch:
        data, ids, sizes = (np.concatenate(x) for x in zip(*held))
        blob = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
        columns = [[task << 32 | seq], [len(data)], [blob], [ids.tobytes()], [sizes.tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "n", "data", "ids", "sizes"])

    for batch in batches:
        octets, offsets = buffers(batch.column(1))
        ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy()
        at = 0
        while at < len(ids):
            end = int(np.searchsorted(offsets, offsets[at] + max(CHUNK - size, 1), "left"))
            end = min(max(end, at + 1), len(ids), at + ROWS - rows)
            held.append((octets[offsets[at] : offsets[end]].copy(), ids[at:end].copy(), np.diff(offsets[at : end + 1])))
            size, rows, at = size + int(offsets[end] - offsets[at]), rows + end - at, end
            if size >= CHUNK or rows >= ROWS:
                yield chunk()
                held, size, rows, seq = [], 0, 0, seq + 1
    if held:
        yield chunk()


@lru_cache(maxsize=2)
def weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(_BASE, n), powers(_INVERSE, n)


class Chunk:
    """Names of the places of a chunk. ``bits``: binary digits of a name that choose its range."""

    def __init__(self, row: dict, bits: int):
        self.bits = np.uint64(bits)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max(row["n"], 1)), np.uint8)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        n = len(self.data)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        self.place = np.arange(n, dtype=np.int32) - (self.ends - self.sizes).astype(np.int32)[self.doc]
        self.left = self.sizes.astype(np.int32)[self.doc] - self.place  # bytes to the end of the row
        forth, self.back = weights(1 << max(21, n.bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data + np.uint64(1)) * forth[:n], out=self.sums[1:])

    def names(self, at: np.ndarray, size: int) -> np.ndarray:
        return mixed((self.sums[at + size] - self.sums[at]) * self.back[at])

    def short(self, names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names in order, cut to 32 digits and those of the range; which one each place has; whether several rows
        of this chunk have it. ``at``: the places, in order within each stretch."""
        distinct, which = np.unique(names >> (np.uint64(32) - self.bits), return_inverse=True)
        some, other = np.zeros((2, len(distinct)), np.int32)
        rows = self.doc[at]
        some[which] = rows
        other[which[::-1]] = rows[::-1]
        return distinct, which, some != other

    def sampled(self) -> None:
        """Step 1: sampled places with ``KEY`` bytes after them."""
        in_cover = np.zeros(PERIOD, bool)
        in_cover[list(COVER)] = True
        self.sample = np.flatnonzero(in_cover[self.place % PERIOD] & (self.left >= KEY))
        self.first = self.short(self.names(self.sample, KEY), self.sample)

    def reached(self, partner: np.ndarray) -> None:
        """Step 2: what passages share that reach a sampled place at a shift of a band."""
        at = self.sample[partner[self.first[1]]]
        self.reach, names = [], []
        for number, (near, far) in enumerate(BANDS):
            size = LENGTH - far + near
            fits = at[(self.place[at] >= near) & (self.left[at] + near >= size)]
            self.reach.append(fits)
            names.append(mixed(self.names(fits - near, size) + np.uint64(number)))
        self.second = self.short(np.concatenate(names), np.concatenate(self.reach))

    def passages(self, partner: np.ndarray) -> None:
        """Step 3: places whose passage reaches a place with a partner, and the distinct names of these passages."""
        possible = np.flatnonzero(self.left >= LENGTH)
        hit = np.zeros(len(possible), bool)
        done = 0
        for (near, far), at in zip(BANDS, self.reach):
            seen = np.zeros(len(self.data) + 1, np.int32)
            seen[at[partner[self.second[1][done : done + len(at)]]] + 1] = 1
            np.cumsum(seen, out=seen)
            hit |= seen[possible + far + 1] > seen[possible + near]
            done += len(at)
        self.starts = possible[hit]
        self.long, self.passage = np.unique(self.names(self.starts, LENGTH), return_inverse=True)
        self.owner = np.full(len(self.long), NO_ID)
        np.minimum.at(self.owner, self.passage, self.ids[self.doc[self.starts]])
        # names are sent by range and, within a range, by owner
        self.order = np.lexsort((self.owner, self.long >> (np.uint64(64) - self.bits)))

    def ranges(self, names: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
        """Ranges of names that occur, with their part of the sorted names."""
        number = (names >> np.uint64(width)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1], [True]])) if len(number) else np.zeros(1, int)
        for a, b in zip(cuts, cuts[1:]):
            yield int(number[a]), int(a), int(b)

    def cut(self, earlier: np.ndarray) -> list[tuple]:
        """Per row: id, bytes, bytes removed, spans removed, digest of the rest. ``earlier``: answers in the order sent."""
        by_name = np.empty_like(earlier)
        by_name[self.order] = earlier
        gone = by_name[self.passage] | (self.ids[self.doc[self.starts]] > self.owner[self.passage])
        step = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(step, self.starts[gone], 1)
        np.add.at(step, self.starts[gone] + LENGTH, -1)
        removed = np.cumsum(step[:-1]) > 0
        begins = removed.copy()
        begins[1:] &= ~removed[:-1] | (self.doc[1:] != self.doc[:-1])
        rows = len(self.ids)
        n_removed = np.bincount(self.doc[removed], minlength=rows)
        n_spans = np.bincount(self.doc[begins], minlength=rows)
        kept = self.data[~removed]
        ends = np.cumsum(self.sizes - n_removed)
        digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip([0, *ends[:-1]], ends)]
        ids = [None if i == NO_ID else i for i in self.ids.tolist()]
        return list(zip(ids, self.sizes.tolist(), n_removed.tolist(), n_spans.tolist(), digests))


# ------------------------------------------------------------------------------------------------- names


def short_rows(row: dict, chunk: Chunk, names: np.ndarray, shared: np.ndarray) -> list[tuple]:
    """(range, chunk, names, shared): names of a chunk, by range."""
    return [
        (r, row["chunk"], names[a:b].astype(np.uint32).tobytes(), np.packbits(shared[a:b]).tobytes()) for r, a, b in chunk.ranges(names, 32)
    ]


def as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


SHORT = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("names", pa.binary()), ("shared", pa.binary())])
LONG = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("names", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])
REST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def first_names(bits: int):
    """Chunks to the names of their sampled places."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, bits)
                chunk.sampled()
                names, _, shared = chunk.first
                yield from as_table(short_rows(row, chunk, names, shared), SHORT).to_batches(64)

    return each


def second_names(bits: int):
    """A chunk and its first answers to the longer names of its sampled places."""

    def each(chunks: pa.Table, masks: pa.Table) -> pa.Table:
        found = []
        for row in chunks.to_pylist():
            chunk = Chunk(row, bits)
            chunk.sampled()
            chunk.reached(bits_of(masks, 1, len(chunk.first[0])))
            names, _, shared = chunk.second
            found += short_rows(row, chunk, names, shared)
        return as_table(found, SHORT)

    return each


def with_partner(step: int):
    def each(group: pd.DataFrame) -> pd.DataFrame:
        """One bit for each name of a chunk: whether another document has it."""
        parts = [np.frombuffer(x, np.uint32) for x in group["names"]]
        sizes = [len(p) for p in parts]
        shared = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(group["shared"], sizes)])
        _, which, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        several = counts > 1
        several[which[shared > 0]] = True
        return answers(group, several[which], sizes, step)

    return each


def third_names(bits: int):
    """A chunk and its answers to the names of its passages."""

    def each(chunks: pa.Table, masks: pa.Table) -> pa.Table:
        found = []
        for row in chunks.to_pylist():
            chunk = resumed(row, masks, bits)
            octets = chunk.long[chunk.order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
            owners = chunk.owner[chunk.order]
            for r, a, b in chunk.ranges(chunk.long, 64 - bits):
                ids, counts = np.unique(owners[a:b], return_counts=True)
                found.append((r, row["chunk"], octets[a:b].tobytes(), ids.tobytes(), counts.astype(np.int32).tobytes()))
        return as_table(found, LONG)

    return each


def resumed(row: dict, masks: pa.Table, bits: int) -> Chunk:
    """A chunk with the answers of steps 1 and 2 applied."""
    chunk = Chunk(row, bits)
    chunk.sampled()
    chunk.reached(bits_of(masks, 1, len(chunk.first[0])))
    chunk.passages(bits_of(masks, 2, len(chunk.second[0])))
    return chunk


def with_earlier(group: pd.DataFrame) -> pd.DataFrame:
    """One bit for each passage of a chunk: whether a document that is smaller than all of the chunk's has it."""
    parts = [np.frombuffer(x, np.uint8).reshape(-1, 7) for x in group["names"]]
    sizes = [len(p) for p in parts]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :7] = np.concatenate(parts)
    owners = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.int32)) for i, n in zip(group["owners"], group["counts"])])
    _, which = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    least = np.full(which.max(initial=-1) + 1, NO_ID)
    np.minimum.at(least, which, owners)
    return answers(group, least[which] < owners, sizes, 3)


def answers(group: pd.DataFrame, bits: np.ndarray, sizes: list[int], step: int) -> pd.DataFrame:
    ends = np.cumsum(sizes)
    masks = [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
    return pd.DataFrame({"chunk": group["chunk"], "step": step, "range": group["range"], "n": sizes, "mask": masks})


def bits_of(masks: pa.Table, step: int, n: int) -> np.ndarray:
    """A chunk's answers of one step, in the order of its names."""
    rows = sorted((r for r in masks.to_pylist() if r["step"] == step), key=lambda r: r["range"])
    parts = [np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=r["n"]) for r in rows]
    out = np.concatenate([*parts, np.zeros(0, np.uint8)]).astype(bool)
    assert len(out) == n
    return out


def rest(bits: int):
    """A chunk and all its answers to the result rows."""

    def each(chunks: pa.Table, masks: pa.Table) -> pa.Table:
        found = []
        for row in chunks.to_pylist():
            chunk = resumed(row, masks, bits)
            found += chunk.cut(bits_of(masks, 3, len(chunk.long)))
        return as_table(found, REST)

    return each


ANSWER = "chunk long, step int, range long, n long, mask binary"


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    importable(docs.sparkSession)
    chunks = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, "chunk long, n long, data binary, ids binary, sizes binary")
    # in buckets, so that answers come to their chunk and no text moves
    path = f"{shared_folder(spark)}/{name}"
    chunks.write.option("path", path).option("compression", "none").bucketBy(partitions(spark), "chunk").saveAsTable(name)
    chunks = spark.table(name)
    total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(8, (total // 5 // NAMES).bit_length())
    short, long = "range long, chunk long, names binary, shared binary", "range long, chunk long, names binary, owners binary, counts binary"

    def with_answers(answered: DataFrame):
        return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk"))

    names = chunks.mapInArrow(first_names(bits), short)
    answered = stored(names.groupBy("range").applyInPandas(with_partner(1), ANSWER), "names")
    names = with_answers(answered).applyInArrow(second_names(bits), short)
    answered = answered.unionByName(stored(names.groupBy("range").applyInPandas(with_partner(2), ANSWER), "names"))
    names = with_answers(answered).applyInArrow(third_names(bits), long)
    answered = answered.unionByName(stored(names.groupBy("range").applyInPandas(with_earlier, ANSWER), "names"))
    return with_answers(answered).applyInArrow(rest(bits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
