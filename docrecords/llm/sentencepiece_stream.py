"""SentencePiece encoding and decoding by a streaming Viterbi pass.

A text is read from left to right. For every boundary the pass keeps the best last piece, a backpointer; only boundaries
that the longest piece can still reach are alive, so the window is bounded by the longest piece. Whenever the paths back
from all live boundaries meet in one, everything up to it is final: its ids are committed and forgotten.

* Unigram models: the best path has the largest sum of scores (the pieces' log probabilities).
* BPE models: a path is allowed if each pair of neighbouring pieces is what merging gives for their joined text. There is
  exactly one allowed path to every boundary, and it is the merge result. Pairs are tested by merging them, once each.

No piece of a model spans certain places (for instance before a word mark, or around a character that no piece holds). Paths
always meet there, so texts are cut there first, and the ids of cut parts are remembered, up to twice ``remembered`` per
Python worker.

Defined results: null gives null ids; an empty text gives none. Characters outside the vocabulary become byte pieces, or
the unknown id where a model has none. Decoding gives the text back, but for what the model's own rules change (unknown
ids, the word mark character itself). Rows and other columns stay as they are; ``ids`` must not be a column already.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docrecords.llm.common import importable, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# a vocabulary is sent to every task; larger files are refused
MODEL_BYTES = 64 << 20
# numbers of unknown characters, factor of a pair's first number, pairs that are remembered
BEYOND, PAIR, PAIRS = 1 << 21, 1 << 23, 1 << 20


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ((4 if kind == 5 else 8), at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Vocabulary:
    """Pieces, scores and text rules of a model file's bytes."""

    def __init__(self, model: bytes):
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        trainer, normalizer = {}, {}
        for number, value in wire(model):
            if number in (2, 3):
                (trainer if number == 2 else normalizer).update(dict(wire(value)))
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models are known")
        if trainer.get(24) or not normalizer.get(5, 1):
            raise ValueError("the word mark must come before words")
        self.dummy = bool(normalizer.get(3, 1))
        self.plain = not normalizer.get(2) and not normalizer.get(4, 1)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = [sp.get_score(i) for i in range(n)]
        self.unknown = sp.unk_id()
        byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_ids = byte_ids if len(byte_ids) == 256 else None
        self.longest = max(map(len, self.ids), default=1)
        #: pairs of characters that some piece holds side by side; between others paths always meet
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        endings: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                endings.setdefault(piece[-2:], set()).add(len(piece))
        #: lengths of the pieces that end in two given characters, longest first
        self.endings = {e: tuple(sorted(n, reverse=True)) for e, n in endings.items()}
        worst = min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.unknown_score = worst - 10.0
        # whether paths meet before every blank that follows a letter, and around line ends
        self.cut_blank = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cut_line = not any("\n" in p for p in self.ids)
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.octets = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        for i in self.control:
            self.octets[i] = b""
        if self.unknown >= 0:
            self.octets[self.unknown] = " ⁇ ".encode()

    def normalize(self, text: str) -> str:
        """The text that is segmented, with word marks."""
        if not text:
            return ""
        if not self.plain:
            return self.sp.normalize(text)
        return (MARK if self.dummy else "") + text.replace(" ", MARK)

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                id_ = self.ids.get(parts[i] + parts[i + 1])
                if id_ is not None and (best is None or self.scores[id_] > best):
                    best, at = self.scores[id_], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Encoder:
    """Encodes text that arrives in parts. ``feed`` and ``finish`` return the ids that are final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[int, bool] = {}
        self.extend = self.extend_bpe if vocabulary.bpe else self.extend_unigram
        self.reset()

    def reset(self) -> None:
        self.window = ""  # text since the last committed boundary
        self.last = [""]  # best last piece at each boundary of the window
        self.numbers = [-1]  # the same by number, for BPE models
        self.best = [0.0]  # its path's score, for unigram models

    def number(self, piece: str) -> int:
        """Id of a piece; characters outside the vocabulary get numbers beyond it."""
        id_ = self.v.ids.get(piece)
        return BEYOND + ord(piece) if id_ is None else id_

    def allowed(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay apart when their joined text is merged."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        fits = not left or self.v.merged(left + right) == [left, right]
        self.pairs[self.number(left) * PAIR + self.number(right) if left else self.number(right) - PAIR] = fits
        return fits

    def extend_bpe(self, text: str) -> None:
        """Extends the window; the best last piece is the only one that may follow the best piece before it."""
        window, last, numbers, endings = self.window, self.last, self.numbers, self.v.endings
        known, get = self.pairs.get, self.v.ids.get
        for char in text:
            window += char
            end = len(last)
            for n in endings.get(window[-2:], ()):
                if n > end:
                    continue
                id_ = get(window[-n:])
                if id_ is not None:
                    fits = known(numbers[end - n] * PAIR + id_)
                    if fits is None:
                        fits = self.allowed(last[end - n], window[-n:])
                    if fits:
                        last.append(window[-n:])
                        numbers.append(id_)
                        break
            else:
                last.append(char)
                numbers.append(get(char, BEYOND + ord(char)))
        self.window = window

    def extend_unigram(self, text: str) -> None:
        """Extends the window; the best last piece has the best sum of scores."""
        window, last, best, ids, endings = self.window, self.last, self.best, self.v.ids, self.v.endings
        for char in text:
            window += char
            end = len(last)
            id_ = ids.get(char)
            chosen, top = char, best[end - 1] + (self.v.unknown_score if id_ is None else self.v.scores[id_])
            for n in endings.get(window[-2:], ()):
                id_ = ids.get(window[-n:]) if n <= end else None
                if id_ is not None and best[end - n] + self.v.scores[id_] > top:
                    chosen, top = window[-n:], best[end - n] + self.v.scores[id_]
            last.append(chosen)
            best.append(top)
        self.window = window

    def path(self, end: int) -> list[str]:
        pieces = []
        while end > 0:
            pieces.append(self.last[end])
            end -= len(pieces[-1])
        return pieces[::-1]

    def meeting(self) -> int:
        """The last boundary that the paths from all live boundaries share."""
        end = len(self.window)
        live = set(range(max(0, end - self.v.longest + 1), end + 1))
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(far - len(self.last[far]))
        return live.pop()

    def commit(self, upto: int) -> list[int]:
        out = []
        for piece in self.path(upto):
            id_ = self.v.ids.get(piece)
            out.extend(self.v.fallback(piece) if id_ is None else (id_,))
        if upto:
            kept = self.last[upto]
            self.window, self.last = self.window[upto:], self.last[upto:]
            if self.v.bpe:
                self.numbers = self.numbers[upto:]
            else:
                self.best = [b - self.best[upto] for b in self.best[upto:]]
            # the committed piece still decides which pieces may follow
            self.last[0] = kept
        return out

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        step = 4 * self.v.longest
        for at in range(0, len(text), step):
            self.extend(text[at : at + step])
            if len(self.window) >= step:
                out += self.commit(self.meeting())
        return out

    def finish(self) -> list[int]:
        out = self.commit(len(self.window))
        self.reset()
        return out


class Segments(dict):
    """Ids of cut parts of normalized text, as packed 32-bit numbers; parts are encoded when first asked for.

    Two generations of at most ``remembered`` parts each: when the young one is full it becomes the old one, and parts
    found there come back.
    """

    def __init__(self, vocabulary: Vocabulary, remembered: int):
        super().__init__()
        self.encoder, self.remembered, self.old = Encoder(vocabulary), remembered, {}

    def __missing__(self, part: str) -> bytes:
        packed = self.old.get(part)
        if packed is None:
            inside = self.encoder.v.inside
            cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in inside]
            if cuts:
                packed = b"".join([self[part[a:b]] for a, b in zip([0, *cuts], [*cuts, len(part)])])
            else:
                packed = array("i", self.encoder.feed(part) + self.encoder.finish()).tobytes()
        if len(part) <= 64:
            if len(self) >= self.remembered:
                self.old = dict(self)
                self.clear()
            self[part] = packed
        return packed


def cut(vocabulary: Vocabulary, normal: str) -> list[str]:
    """Parts of normalized text between places where paths always meet."""
    if not vocabulary.cut_blank:
        return [normal]
    if vocabulary.cut_line:
        if MARK + MARK in normal or "\0" in normal:
            return re.findall(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+", normal)
        return normal.replace(MARK, "\0" + MARK).replace("\n", "\0\n\0").split("\0")
    return re.findall(rf"{MARK}*[^{MARK}]+|{MARK}+", normal)


def encode(text: str, vocabulary: Vocabulary, segments: Segments) -> bytes:
    return b"".join(map(segments.__getitem__, cut(vocabulary, vocabulary.normalize(text))))


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """Text of ids; byte pieces that form no character become the replacement character, each."""
    octets = vocabulary.octets
    raw = b"".join([octets[i] for i in ids])
    if vocabulary.dummy and raw[:1] == b" " and ids and ids[0] not in vocabulary.control:
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(model: bytes, remembered: int) -> tuple[Vocabulary, Segments]:
    """A worker's vocabulary and what it remembers, kept from task to task."""
    vocabulary = Vocabulary(model)
    return vocabulary, Segments(vocabulary, remembered)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    return data


def with_ids(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "ids", remembered: int = 500_000, back: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text``; with ``back``, also with the text decoded from them in a column of that name."""
    importable(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    at = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, segments = loaded(data.value, remembered)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = batch.column(at).to_pylist()
                packed = [None if t is None else encode(t, vocabulary, segments) for t in texts]
                lengths = np.array([len(p or b"") // 4 for p in packed])
                flat = np.frombuffer(b"".join(p for p in packed if p), np.int32)
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                mask = pa.array([p is None for p in packed])
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=mask)]
                if back:
                    numbers = flat.tolist()
                    columns.append(
                        pa.array([None if t is None else decode(numbers[a:b], vocabulary) for t, a, b in zip(texts, ends, ends[1:])], pa.string())
                    )
                names = [*batch.schema.names, ids, *([back] if back else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if back:
        schema = schema.add(back, "string")
    return docs.mapInArrow(each, schema)


def with_text(encoded: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids."""
    data = encoded.sparkSession.sparkContext.broadcast(model_bytes(model))
    at = encoded.columns.index(ids)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = loaded(data.value, 1)
        for batch in batches:
            texts = [None if x is None else decode(x, vocabulary) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return encoded.mapInArrow(each, T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())]))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, their number, and the digest of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_ids(docs, back="decoded")
    return out.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("same_text")
    )
