"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. The vector of an n-gram is the product of its
letters' vectors, each rotated by its place; everything that is not a letter is one more letter, the gap, which marks word
ends. A text is the sum of its n-grams with a letter in the middle, a language the sum of its texts, and a text is
of the language with the largest cosine. Sums of texts are whole numbers, so the profiles do not depend on their order.

Profiles are learned from all rows that may be learned from. Each task adds up its own rows; what is added between tasks
are vectors by language, so the number of languages is taken to be small (8 KB each in every task).

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all texts where nothing was learned.
Ties go to the first language by name. A text of one letter has one n-gram. Repeated rows are judged each; extra columns do
not matter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.llm.common import importable, is_held_out, table

UNKNOWN = "und"
DIMENSIONS = 1024
SEED = 20
GROUP = 256
# characters of one count; longer texts are counted in parts
PART = 1 << 20
DENSE = 1 << 22


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


@lru_cache(maxsize=1 << 14)
def letter_vector(code: int) -> np.ndarray:
    bits = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return 2 * bits - 1


def parts_of(texts: list[str]) -> Iterator[list[tuple[int, int, int, str]]]:
    """(row, place, length of the text, part) in portions of about ``PART`` characters; parts of a long text overlap by the two letters around a cut."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text), 1), PART):
            piece = text[max(0, at - 1) : at + PART + 1]
            held.append((row, at, len(text), piece))
            size += len(piece)
            if size >= PART:
                yield held
                held, size = [], 0
    if held:
        yield held


def gram_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Portions of trigram counts: the texts of the portion, its symbols (code points, 0 for the gap), its trigrams as rows
    of three symbol numbers, and the counts of texts by trigrams."""
    for portion in parts_of([(t or "").lower() for t in texts]):
        codes, owner = [], []
        for row, at, length, piece in portion:
            # a gap at either end of the text; at a cut, the neighbour itself
            first, last = at == 0, at + PART >= length
            codes += [" " if first else "", piece, " " if last else ""]
            n = len(piece) + first + last
            owner.append((row, n))
        flat = np.frombuffer("".join(codes).encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = np.array([o[0] for o in owner])
        lengths = np.array([o[1] for o in owner])
        part = np.repeat(np.arange(len(owner)), lengths)
        code = np.where(letters()[flat], flat, 0)
        inner = np.flatnonzero((code[1:-1] > 0) & (part[:-2] == part[2:])) if len(code) > 2 else np.zeros(0, int)
        symbols, number = compact(code)
        k = len(symbols)
        grams = (number[inner] * k + number[inner + 1]) * k + number[inner + 2]
        if k**3 <= DENSE:
            present = np.flatnonzero(np.bincount(grams, minlength=1))
            place = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
            place[present] = np.arange(len(present))
            place = place[grams]
        else:
            present, place = np.unique(grams, return_inverse=True)
        texts_here, of_part = np.unique(rows, return_inverse=True)
        cell = of_part[part[inner + 1]] * len(present) + place
        matrix = np.bincount(cell, minlength=len(texts_here) * len(present)).reshape(len(texts_here), len(present))
        triples = np.column_stack([present // (k * k), present // k % k, present % k])
        yield texts_here, symbols, triples, matrix


def compact(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(int(code.max(initial=0)) + 1, bool)
    seen[code] = True
    number = np.cumsum(seen) - 1
    return np.flatnonzero(seen), number[code]


def gram_vectors(symbols: np.ndarray, triples: np.ndarray) -> np.ndarray:
    base = np.array([letter_vector(int(s)) for s in symbols], np.int8).reshape(len(symbols), DIMENSIONS)
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
    return (first[triples[:, 0]] * second[triples[:, 1]] * base[triples[:, 2]]).astype(np.float32)


def learn(rows: DataFrame) -> dict[str, np.ndarray]:
    """Profiles from ``rows(text, lang)``, by language."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                langs = np.array(batch.column(1).to_pylist(), dtype=object)
                for texts, symbols, triples, matrix in gram_counts(batch.column(0).to_pylist()):
                    vectors = gram_vectors(symbols, triples)
                    for lang in sorted(set(langs[texts])):
                        counts = matrix[langs[texts] == lang].sum(axis=0)
                        total = (counts.astype(np.float64) @ vectors).astype(np.int64)
                        sums[lang] = sums.get(lang, 0) + total
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "profile"]
            )

    importable(rows.sparkSession)
    sums = rows.mapInArrow(each, "lang string, profile array<long>")
    by_place = sums.select("lang", F.posexplode("profile").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    profiles: dict[str, np.ndarray] = {}
    for row in by_place.collect():
        profiles.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["at"]] = row["v"]
    return {lang: profiles[lang] for lang in sorted(profiles)}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row."""
    names = np.array([*profiles, UNKNOWN], dtype=object)
    raw = np.array(list(profiles.values())).reshape(len(profiles), DIMENSIONS)
    unit = (raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)).T.astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((names, unit))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, GROUP):
                batch = whole.slice(start, GROUP)
                vectors = np.zeros((batch.num_rows, DIMENSIONS), np.float64)
                for texts, symbols, triples, matrix in gram_counts(batch.column(1).to_pylist()):
                    vectors[texts] += matrix.astype(np.float32) @ gram_vectors(symbols, triples)
                size = np.linalg.norm(vectors, axis=1)
                cosine = np.zeros((batch.num_rows, len(names)))
                cosine[:, :-1] = np.round(vectors @ unit / np.maximum(size, 1e-12)[:, None], 6)
                cosine[:, -1] = np.where(size > 0, -2.0, 2.0)
                best = cosine.argmax(axis=1)
                known = best < len(names) - 1
                score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    importable(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.filter(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    out = identify(docs, learn(learned.select("text", "lang")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
