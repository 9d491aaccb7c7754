"""Hashed word counts and byte-class counts of texts, computed on Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLANKS = b" \t\n\x0b\x0c\r"
#: byte classes that are counted; bytes of characters beyond ASCII are the last
CLASSES = ("blank", "line", "digit", "upper", "lower", "symbol", "shout", "stop", "other", "wide")
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def class_of_byte() -> np.ndarray:
    groups = {"blank": b" \t\x0b\x0c\r", "line": b"\n", "digit": b"0123456789", "symbol": b"#*$%&|<>", "shout": b"!?", "stop": b".,;:"}
    out = np.full(256, CLASSES.index("other"), dtype=np.uint8)
    out[65:91], out[97:123], out[128:] = CLASSES.index("upper"), CLASSES.index("lower"), CLASSES.index("wide")
    for name, members in groups.items():
        out[list(members)] = CLASSES.index(name)
    return out


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls count as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    octets = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return octets[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(octets: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``BLOCK``, cut at ends of rows or, within a long row, at blanks."""
    at, n = 0, len(octets)
    while at < n:
        end = min(n, at + BLOCK)
        if end < n:
            row = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if row > at:
                end = row
            else:
                last = int(offsets[np.searchsorted(offsets, at, "right")])
                while end < last and octets[end] not in BLANKS:
                    end += 1
        yield at, end
        at = end


def word_hashes(octets: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each word. ``row`` gives the row of each byte; a word ends with its row."""
    if not len(octets):
        return row[:0], np.zeros(0, np.uint64)
    solid = class_of_byte()[octets] > 1
    edge = np.empty(len(octets), bool)
    edge[0], edge[1:] = True, row[1:] != row[:-1]
    before = np.empty(len(octets), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (edge | ~before))
    after = np.empty(len(octets), bool)
    after[-1], after[:-1] = True, ~solid[1:] | edge[1:]
    ends = np.flatnonzero(solid & after)
    size = max(BLOCK, 1 << (len(octets) - 1).bit_length())
    total = np.cumsum((octets + np.uint64(1)) * powers(int(_BASE), size)[: len(octets)], dtype=np.uint64)
    head = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return row[starts], mixed((total[ends] - head) * powers(int(_BASE_INVERSE), size)[starts])


def counts(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how often each word bucket and each byte class occurs. ``buckets`` is a power of two."""
    octets, offsets = buffers(texts)
    n = len(texts)
    words = np.zeros(n * buckets, np.int64)
    classes = np.zeros(n * len(CLASSES), np.int64)
    of_byte = class_of_byte()
    for lo, hi in blocks(octets, offsets):
        first = int(np.searchsorted(offsets, lo, "right")) - 1
        last = int(np.searchsorted(offsets, hi, "left"))
        sizes = np.diff(np.clip(offsets[first : last + 1], lo, hi))
        row = np.repeat(np.arange(first, last), sizes)
        part = octets[lo:hi]
        of_word, hashes = word_hashes(part, row)
        words += np.bincount(of_word * buckets + (hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=len(words))
        classes += np.bincount(row * len(CLASSES) + of_byte[part], minlength=len(classes))
    return words.reshape(n, buckets), classes.reshape(n, len(CLASSES))


def shape(words: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Structure statistics of each row, each about 0 to 1: shares of byte classes, size, word length, variety, line length."""
    n_bytes = classes.sum(axis=1)
    n_words = words.sum(axis=1)
    some_bytes, some_words = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    lines = classes[:, CLASSES.index("line")] + 1
    more = [
        np.log1p(n_words) / 12,
        (n_bytes - classes[:, :2].sum(axis=1)) / some_words / 16,
        (words > 0).sum(axis=1) / some_words,
        words.max(axis=1, initial=0) / some_words,
        np.log1p(n_words / lines) / 8,
    ]
    return np.column_stack([classes / some_bytes[:, None], *more]).astype(np.float32)


SHAPES = len(CLASSES) + 5
