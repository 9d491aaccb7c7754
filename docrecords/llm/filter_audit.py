"""Filter interaction audit: what each of five filters removes in every order, per part of the corpus.

Spark gives every document a 5-bit failure mask (A: under 50 words; B: under 65 % distinct words; C: over 5 % capitals
A-Z among code points; D: any of ``#$%&*|``; E: the same text as a smaller doc_id anywhere in the table, removed or not)
and counts the documents per (part, mask, good, toxic) with a pre-aggregated shuffle, so that at most 32 x 4 cells per part
remain. Per part, a Gray-code walk visits all 32 subsets of filters, toggling one filter at a time: every cell keeps a
counter of its active failures, and the running survivors (all, good, toxic) change by the cells whose counter leaves or
reaches zero. The 32 states are stored; every step of every order is a difference of two of them.

Defined results: null text counts as empty (so A fails); null source forms the part ``""``. Equal texts are found by their
SHA-256 over the whole text; E holds for a row whose doc_id is larger than the smallest doc_id of its text, so rows that
share both id and text are not E by each other, and null ids are never E and make no other row E. Labels that repeat an id
count as good (toxic) if any of them says so; documents without labels are neither. An empty table gives no rows. Extra
columns do not matter; working columns start with ``_f_``.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.llm.common import importable, table

# fixed values of the contract: the filters, their order of bits, and their limits
LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
MIN_WORDS, DISTINCT_PCT, CAPITALS_PCT = 50, 65, 5

ORDERS = ["".join(p) for p in permutations(LETTERS)]
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def failure_masks(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(part, _f_mask, _f_good, _f_toxic)`` per document; bit i of the mask is filter ``LETTERS[i]``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    rows = docs.select(
        F.col("doc_id").alias("_f_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("_f_digest"),
        words.alias("_f_words"),
        F.length(text).alias("_f_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).alias("_f_caps"),
        text.rlike(SYMBOLS).alias("_f_symbols"),
    )
    firsts = rows.groupBy("_f_digest").agg(F.min("_f_id").alias("_f_first"))
    joined = rows.join(firsts, "_f_digest", "left")
    n = F.size("_f_words")
    bits = [
        n < MIN_WORDS,
        F.lit(100) * F.size(F.array_distinct("_f_words")) < F.lit(DISTINCT_PCT) * n,
        F.lit(100) * F.col("_f_caps") > F.lit(CAPITALS_PCT) * F.col("_f_chars"),
        F.col("_f_symbols"),
        F.coalesce(F.col("_f_id") > F.col("_f_first"), F.lit(False)),
    ]
    mask = sum((F.when(b, F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(bits)), F.lit(0))
    masked = joined.select("_f_id", "part", mask.alias("_f_mask"))
    if labels is None:
        return masked.select("part", "_f_mask", F.lit(0).alias("_f_good"), F.lit(0).alias("_f_toxic"))
    flags = labels.groupBy(F.col("doc_id").alias("_f_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("_f_good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("_f_toxic"),
    )
    return masked.join(flags, "_f_id", "left").select(
        "part", "_f_mask", F.coalesce("_f_good", F.lit(0)).alias("_f_good"), F.coalesce("_f_toxic", F.lit(0)).alias("_f_toxic")
    )


def gray_states(masks: np.ndarray, counts: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Survivors (all, good, toxic) of every subset of filters, as a 32 x 3 array indexed by the subset's bits."""
    weights = np.stack([counts, counts * good, counts * toxic], axis=1).astype(np.int64)
    active = np.zeros(len(masks), dtype=np.int64)
    alive = weights.sum(axis=0)
    states = np.zeros((1 << len(LETTERS), 3), dtype=np.int64)
    subset = 0
    states[0] = alive
    for i in range(1, 1 << len(LETTERS)):
        bit = (i ^ (i >> 1)) ^ (subset)
        hit = (masks & bit) != 0
        if subset & bit:
            # filter off: cells whose last active failure it was come back
            back = hit & (active == 1)
            alive = alive + weights[back].sum(axis=0)
            active[hit] -= 1
        else:
            gone = hit & (active == 0)
            alive = alive - weights[gone].sum(axis=0)
            active[hit] += 1
        subset ^= bit
        states[subset] = alive
    return states


def audit_part(part: str, cells: pd.DataFrame) -> pd.DataFrame:
    masks = cells["_f_mask"].to_numpy(np.int64)
    counts = cells["_f_n"].to_numpy(np.int64)
    states = gray_states(masks, counts, cells["_f_good"].to_numpy(np.int64), cells["_f_toxic"].to_numpy(np.int64))
    fails = {x: int(counts[(masks >> i) & 1 == 1].sum()) for i, x in enumerate(LETTERS)}
    unique = {x: int(counts[masks == 1 << i].sum()) for i, x in enumerate(LETTERS)}
    rows, shapley = [], dict.fromkeys(LETTERS, 0)
    for order in ORDERS:
        before = 0
        for step, x in enumerate(order, start=1):
            after = before | 1 << LETTERS.index(x)
            removed = int(states[before, 0] - states[after, 0])
            shapley[x] += removed
            rows.append([part, order, step, int(states[after, 0]), removed, fails[x] - removed, unique[x],
                         int(states[before, 1] - states[after, 1]), int(states[before, 2] - states[after, 2]), x])
            before = after
    out = pd.DataFrame(rows, columns=[*SCHEMA_NAMES[:-1], "_f_letter"])
    out["shapley"] = out.pop("_f_letter").map(shapley).astype("int64")
    out["step"] = out["step"].astype("int32")
    return out


def audit(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per part, order of the five filters and step; see the module for the counts."""
    importable(docs.sparkSession)
    cells = failure_masks(docs, labels).groupBy("part", "_f_mask", "_f_good", "_f_toxic").agg(F.count(F.lit(1)).alias("_f_n"))

    def each(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return audit_part(key[0], frame)

    return cells.groupBy("part").applyInPandas(each, SCHEMA)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first_id FROM d GROUP BY t
), f AS (
  SELECT d.part,
         len(d.w) < 50 AS fa,
         100 * len(list_distinct(d.w)) < 65 * len(d.w) AS fb,
         100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 5 * length(d.t) AS fc,
         regexp_matches(d.t, '[#$%&*|]') AS fd,
         coalesce(d.doc_id > firsts.first_id, false) AS fe,
         coalesce(lab.good, 0) AS good, coalesce(lab.bad, 0) AS bad
  FROM d JOIN firsts ON firsts.t = d.t LEFT JOIN lab ON lab.doc_id = d.doc_id
), letters AS (
  SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(l)
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.l NOT IN (b.l, c.l, d.l, e.l) AND b.l NOT IN (c.l, d.l, e.l) AND c.l NOT IN (d.l, e.l) AND d.l <> e.l
), steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS x, substr(filter_order, 1, s - 1) AS pre
  FROM orders, range(1, 6) r(s)
), marked AS (
  SELECT f.part, steps.filter_order, steps.step, steps.x, f.good, f.bad,
         CASE steps.x WHEN 'A' THEN f.fa WHEN 'B' THEN f.fb WHEN 'C' THEN f.fc WHEN 'D' THEN f.fd ELSE f.fe END AS hit,
         (f.fa AND contains(pre, 'A')) OR (f.fb AND contains(pre, 'B')) OR (f.fc AND contains(pre, 'C'))
           OR (f.fd AND contains(pre, 'D')) OR (f.fe AND contains(pre, 'E')) AS gone,
         CAST(f.fa AS INT) + CAST(f.fb AS INT) + CAST(f.fc AS INT) + CAST(f.fd AS INT) + CAST(f.fe AS INT) AS n_fails
  FROM f, steps
), counted AS (
  SELECT part, filter_order, step, x,
         count(*) FILTER (WHERE NOT gone AND NOT hit) AS kept,
         count(*) FILTER (WHERE hit AND NOT gone) AS removed,
         count(*) FILTER (WHERE hit AND gone) AS redundant,
         count(*) FILTER (WHERE hit AND n_fails = 1) AS unique_fails,
         count(*) FILTER (WHERE hit AND NOT gone AND good = 1) AS good_lost,
         count(*) FILTER (WHERE hit AND NOT gone AND bad = 1) AS toxic_lost
  FROM marked GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
"""
