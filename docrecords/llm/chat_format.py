"""Chat formatting by columnar byte assembly.

A turn is ``<|im_start|>role\\n`` + text + ``<|im_end|>\\n``. Control strings inside roles and texts get a backslash after
their first character (one more, if there are some), which reading back takes away again; in roles, backslashes and line ends
are escaped too. The loss mask holds the byte ranges of assistant texts.

A batch of turns is assembled at once: lengths of all segments (headers, texts, ends), their running sum as places in the
output, one index that gathers every byte into one preallocated buffer, and Arrow offsets over it. Turns of a conversation
are first assembled in stretches of ``STRETCH`` turn numbers, wherever these lie, and stretches are then joined, so a very
long conversation is not put together turn by turn in one task.

Defined results: turns are ordered by turn, then role, then text; null turns come first; null roles and texts count as empty.
Repeated rows stay. Rows with a null conversation form one conversation. An empty table gives an empty one. Other columns are
left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.llm.common import importable, partitions, table

START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
LEARNED = "assistant"
STRETCH = 64
# bytes of text that are assembled at a time
PORTION = 1 << 22


def _control(slashes: str) -> re.Pattern:
    by_first: dict[str, list[str]] = {}
    for c in CONTROL:
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    return re.compile("|".join(rf"{re.escape(f)}{slashes}(?=(?:{'|'.join(rest)}))" for f, rest in by_first.items()))


PLAIN, ESCAPED = _control(r"\\*"), _control(r"\\+")
# a quick test for texts that need no escape
HINT = "|".join(sorted({re.escape(c[0]) + r"\\*" + re.escape(c[1]) for c in CONTROL}))


def escape(text: str) -> str:
    return PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][:-1], text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def escaped_column(texts: pa.Array) -> pa.Array:
    """The texts with control strings escaped; only texts that may hold one are rewritten."""
    texts = texts.fill_null("").cast(pa.large_string())
    rows = pc.match_substring_regex(texts, HINT)
    if not pc.any(rows).as_py():
        return texts
    fresh = pa.array([escape(t) for t in texts.filter(rows).to_pylist()], pa.large_string())
    return pc.replace_with_mask(texts, rows, fresh)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, where each turn begins (and the last one ends), and the range of each turn's text."""
    texts = escaped_column(texts)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    names = roles.fill_null("").cast(pa.string()).dictionary_encode()
    headers = [(START + escape_role(r) + "\n").encode() for r in names.dictionary.to_pylist()]
    fixed = [*headers, END.encode()]
    fixed_sizes = np.array([len(f) for f in fixed])
    fixed_starts = np.cumsum(fixed_sizes) - fixed_sizes
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    source = np.concatenate([np.frombuffer(b"".join(fixed), np.uint8), body])
    role = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # three segments for each turn: header, text, end
    starts, sizes = np.empty((len(texts), 3), np.int64), np.empty((len(texts), 3), np.int64)
    starts[:, 0], sizes[:, 0] = fixed_starts[role], fixed_sizes[role]
    starts[:, 1], sizes[:, 1] = offsets[:-1] - offsets[0] + fixed_sizes.sum(), np.diff(offsets)
    starts[:, 2], sizes[:, 2] = fixed_starts[-1], fixed_sizes[-1]
    places = np.concatenate([[0], np.cumsum(sizes.ravel())])
    out = np.empty(places[-1], np.uint8)
    np.take(source, np.repeat(starts.ravel() - places[:-1], sizes.ravel()) + np.arange(places[-1]), out=out)
    return out, places[::3], np.column_stack([places[1::3], places[2::3]])


def portions(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // PORTION
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring turns of a stretch as one row; columns conv, part, role, text. A stretch that goes on in the next portion
    becomes two rows, in order of ``seq``."""
    seq = 0
    for whole in batches:
        for batch in portions(whole, 3):
            out, begins, ranges = assemble(batch.column(2), batch.column(3))
            same = np.ones(batch.num_rows, bool)
            for c in (batch.column(0), batch.column(1)):
                values, valid = c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)
                same[1:] &= (values[1:] == values[:-1]) & (valid[1:] == valid[:-1])
            same[0] = False
            first = np.flatnonzero(~same)
            bounds = np.concatenate([begins[first], begins[-1:]])
            joined = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
            learned = pc.fill_null(pc.equal(batch.column(2), LEARNED), False).to_numpy(zero_copy_only=False)
            group = np.cumsum(~same) - 1
            relative = (ranges - bounds[group][:, None])[learned]
            counts = np.bincount(group[learned], minlength=len(first))
            masks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], 2 * np.cumsum(counts)]).astype(np.int32)), pa.array(relative.ravel()))
            n = np.diff(np.concatenate([first, [batch.num_rows]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(first)),
                    batch.column(1).take(pa.array(first)),
                    pa.array(np.arange(seq, seq + len(first))),
                    joined.cast(pa.binary()),
                    masks,
                    pa.array(n),
                ],
                names=["conv_id", "part", "seq", "bytes", "mask", "n_turns"],
            )
            seq += len(first)


class Conversation:
    """Stretches of one conversation."""

    def __init__(self, conv: int | None):
        self.conv, self.parts, self.masks, self.n_turns, self.size = conv, [], [], 0, 0

    def add(self, data: bytes, mask: list[int], n: int) -> None:
        self.parts.append(data)
        self.masks.append(np.array(mask, np.int64) + self.size)
        self.n_turns += n
        self.size += len(data)

    def row(self) -> tuple:
        return self.conv, b"".join(self.parts).decode(), np.concatenate(self.masks).tolist(), self.n_turns


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in order to conversations: conv, text, mask, number of turns."""
    names = ["conv_id", "formatted", "mask", "n_turns"]
    held: Conversation | None = None

    def record(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [conv_type, pa.string(), pa.list_(pa.int64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    conv_type = pa.int64()
    for batch in batches:
        conv_type, rows = batch.schema.field(0).type, []
        for conv, _, _, data, mask, n in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None and held.conv != conv:
                rows.append(held.row())
                held = None
            if held is None:
                held = Conversation(conv)
            held.add(data, mask, n)
        if rows:
            yield record(rows)
    if held is not None:
        yield record([held.row()])


def formatted(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to one row per conversation: formatted, mask (start, end, start, ...), n_turns."""
    n = partitions(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    part = F.floor(F.col("turn") / STRETCH)
    rows = turns.select("conv_id", part.cast("long").alias("part"), "turn", "role", "text")
    rows = rows.repartition(n, "conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text").drop("turn")
    importable(rows.sparkSession)
    pieces = rows.mapInArrow(stretches, f"conv_id {kind}, part long, seq long, bytes binary, mask array<long>, n_turns long")
    pieces = pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return pieces.mapInArrow(joined, f"conv_id {kind}, formatted string, mask array<long>, n_turns long")


TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END), re.DOTALL)


def turns_of(text: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


def learned_of(text: str, mask: list[int]) -> list[str]:
    """The texts under the loss mask."""
    data = text.encode()
    return [unescape(data[a:b].decode()) for a, b in zip(mask[::2], mask[1::2])]


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations say when read back."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
                turns, learned = hashlib.sha256(), hashlib.sha256()
                read = turns_of(text)
                for role, said in read:
                    turns.update(f"{role}\n{said}\n".encode())
                parts = learned_of(text, mask)
                for said in parts:
                    learned.update(said.encode())
                rows.append((conv, len(read), turns.hexdigest(), sum(map(len, parts)), learned.hexdigest(), len(text)))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    importable(conversations.sparkSession)
    return conversations.select("conv_id", "formatted", "mask").mapInArrow(each, schema)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return digests(formatted(turns.unionByName(more)))
