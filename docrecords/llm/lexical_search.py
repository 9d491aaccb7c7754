"""Ranked lexical search: integer BM25-like scores, top ``k`` documents per query by an exact sparse ball-tree search.

A document is a sparse vector over the query vocabulary: for a term of tf occurrences, ``(10^9 tf) div (1000 tf + 12 m)``
with ``m = 75 + (25 n N) div L``. A query is a sparse vector of ``count * w`` with ``w = floor(1000 ln((2N+2)/(2df+1)))``.
The score is their inner product, in 64-bit integers.

Counting is done by Spark in one pass over the texts: terms by a split in the JVM, then a pre-aggregated shuffle on
(row, query term) that keeps one row per document for its other terms; this table is stored, and N, L and df come from
it. Document vectors are dealt by row into trees of about ``TREE_ENTRIES`` entries. Each tree is a ball tree:
nodes split at the median of the projection on the line between two far members; a node keeps its sparse centroid and
radius. Every query walks the tree best-first by the bound ``<q, c> + |q| r``, raised by a safe margin for rounding, and
drops a subtree whose bound is below the k-th score found (equal bounds are walked, since equal scores order by doc_id).
Leaves are scored exactly in integers. The partitions' top ``k`` are merged by a window with a rank limit per query.

Defined results: null text has no terms; a document without query terms scores 0 and is never returned (scores must be
above 0). Rows that share a doc_id are separate documents and may both be returned, ranked by doc_id and then the order
in which the table gives them. Null doc_ids rank after all others at equal scores. Null item texts return nothing; null
item_ids form their own query. An empty table gives an empty result. Extra columns do not matter; working columns start
with ``_s_``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrecords.llm.common import importable, partitions, stored, table

# fixed values of the contract: what a term is, and the constants of the score
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: what lies between terms; terms are the non-empty pieces of a split on it, the same as the maximal matches of TERM
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K1000, B25, M12, SCALE = 1000, 25, 12, 1_000_000_000

TOP = 20
#: members of a leaf of the ball tree
LEAF = 32
#: queries sent to the executors at a time, and query terms at most in a vocabulary that is broadcast
QUERY_BLOCK = 2000
VOCAB_BROADCAST = 1_000_000
#: (document, query term) entries of one tree at most, on average: they set the number of trees
TREE_ENTRIES = 1 << 21


def terms_of(text: F.Column) -> F.Column:
    """Terms of a text, only A-Z lower-cased; null gives none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def weight(n_docs: int, df: F.Column) -> F.Column:
    return F.floor(F.lit(float(K1000)) * F.log((F.lit(2.0 * n_docs + 2.0)) / (F.lit(2.0) * df + F.lit(1.0)))).cast("long")


class BallTree:
    """Ball tree over the rows of a sparse integer matrix (CSR arrays); geometry in doubles, scores in int64."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, values: np.ndarray, leaf: int = LEAF):
        self.indptr, self.indices, self.values = indptr, indices, values
        self.fvalues = values.astype(np.float64)
        self.rows = len(indptr) - 1
        self.dim = int(indices.max()) + 1 if len(indices) else 1
        self.norm2 = np.bincount(np.repeat(np.arange(self.rows), np.diff(indptr)), weights=self.fvalues**2, minlength=self.rows)
        self.leaf = leaf
        # node: (member rows, centroid dims, centroid values, radius, children); a leaf's entries in one piece
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray, float, tuple[int, ...]]] = []
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if self.rows:
            self._build(np.arange(self.rows))

    def _dots(self, members: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Inner products of the member rows with a dense vector."""
        starts, ends = self.indptr[members], self.indptr[members + 1]
        lengths = ends - starts
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        products = self.fvalues[at] * dense[self.indices[at]]
        return np.bincount(np.repeat(np.arange(len(members)), lengths), weights=products, minlength=len(members))

    def _centroid(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        starts, ends = self.indptr[members], self.indptr[members + 1]
        lengths = ends - starts
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        dense = np.bincount(self.indices[at], weights=self.fvalues[at], minlength=self.dim) / len(members)
        dims = np.flatnonzero(dense)
        c2 = float(dense[dims] @ dense[dims])
        dist2 = np.maximum(self.norm2[members] - 2.0 * self._dots(members, dense) + c2, 0.0)
        return dense, dims, dist2, math.sqrt(float(dist2.max()))

    def _build(self, top: np.ndarray) -> None:
        stack = [(top, -1, 0)]
        while stack:
            members, parent, side = stack.pop()
            dense, dims, dist2, radius = self._centroid(members)
            index = len(self.nodes)
            self.nodes.append((members, dims, dense[dims], radius, ()))
            if parent >= 0:
                m, d, v, r, children = self.nodes[parent]
                self.nodes[parent] = (m, d, v, r, (*children, index))
            if len(members) <= self.leaf or radius == 0.0:
                lengths = self.indptr[members + 1] - self.indptr[members]
                at = np.repeat(self.indptr[members] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                self.leaves[index] = (self.indices[at], self.values[at], np.cumsum(lengths) - lengths)
                continue
            a = members[int(np.argmax(dist2))]
            da = self._row_dense(a)
            from_a = self.norm2[members] - 2.0 * self._dots(members, da) + self.norm2[a]
            b = members[int(np.argmax(from_a))]
            line = da - self._row_dense(b)
            projection = self._dots(members, line)
            order = np.argsort(projection, kind="stable")
            half = len(members) // 2
            stack.append((members[order[half:]], index, 1))
            stack.append((members[order[:half]], index, 0))

    def _row_dense(self, row: int) -> np.ndarray:
        dense = np.zeros(self.dim)
        s, e = self.indptr[row], self.indptr[row + 1]
        dense[self.indices[s:e]] = self.fvalues[s:e]
        return dense

    def search(self, q_idx: np.ndarray, q_val: np.ndarray, keys: list[tuple[int, int]], k: int = TOP) -> list[tuple[int, int]]:
        """Rows of the ``k`` best positive scores as ``(score, row)``, best first; equal scores by the smaller key."""
        if not self.rows or not len(q_idx):
            return []
        keep = q_idx < self.dim
        q_idx, q_val = q_idx[keep], q_val[keep]
        q_int = np.zeros(self.dim, dtype=np.int64)
        np.add.at(q_int, q_idx, q_val)
        q = q_int.astype(np.float64)
        q_norm = math.sqrt(float(q @ q))
        best: list[tuple[int, tuple[int, int], int]] = []  # min-heap on (score, inverted key)

        def bound(node: int) -> float:
            _, dims, vals, radius, _ = self.nodes[node]
            raw = float(q[dims] @ vals) + q_norm * radius
            # safe rounding: products and square roots carry relative errors far below this margin
            return raw + abs(raw) * 1e-9 + 1.0

        def kth() -> int:
            return best[0][0] if len(best) == k else 1

        frontier = [(-bound(0), 0)]
        while frontier:
            negative, node = heapq.heappop(frontier)
            if -negative < kth():
                break
            members, _, _, _, children = self.nodes[node]
            if children:
                for child in children:
                    b = bound(child)
                    if b >= kth():
                        heapq.heappush(frontier, (-b, child))
                continue
            indices, values, offsets = self.leaves[node]
            # exact scores of all members at once, in 64-bit integers; every member has an entry
            scores = np.add.reduceat(q_int[indices] * values, offsets)
            for at in np.flatnonzero(scores >= kth()).tolist():
                row = int(members[at])
                entry = (int(scores[at]), _inverted(keys[row]), row)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(score, row) for score, _, row in sorted(best, reverse=True)]


def _inverted(key: tuple[int, int]) -> tuple[int, int]:
    """A key that sorts the smaller doc_id (nulls last) and then the earlier row as larger."""
    doc, row = key
    return (-(doc if doc is not None else 2**63), -row)


def term_frequencies(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(_s_row, doc_id, _s_n, _s_idx, _s_tf)``: every document once with a null term, and once per query term it holds.

    The only pass that cuts texts into terms; ``_s_n`` counts all terms of the document.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_s_row"), F.col("doc_id").cast("long").alias("doc_id"), terms_of(F.col("text")).alias("_s_terms"))
    tokens = rows.select("_s_row", "doc_id", F.size("_s_terms").cast("long").alias("_s_n"), F.explode_outer("_s_terms").alias("_s_term"))
    return tokens.join(known, "_s_term", "left").groupBy("_s_row", "doc_id", "_s_n", "_s_idx").agg(F.count(F.lit(1)).alias("_s_tf"))


def _searched(entries: pa.Table, queries: list[tuple[object, np.ndarray, np.ndarray]], k: int) -> pa.RecordBatch:
    """Top ``k`` of one tree for every query; the entries come sorted by row."""
    rows = entries.column("_s_row").to_numpy()
    starts = np.flatnonzero(np.diff(rows)) + 1
    indptr = np.concatenate([[0], starts, [len(rows)]]).astype(np.int64)
    firsts = indptr[:-1]
    ids = entries.column("doc_id")
    valid = ids.is_valid().to_numpy(zero_copy_only=False)[firsts]
    doc_ids = [int(d) if v else None for d, v in zip(ids.fill_null(0).to_numpy()[firsts].tolist(), valid.tolist())]
    names, indices = np.unique(entries.column("_s_idx").to_numpy(), return_inverse=True)
    tree = BallTree(indptr, indices.astype(np.int64), entries.column("_s_val").to_numpy().astype(np.int64))
    keys = list(zip(doc_ids, rows[firsts].tolist()))
    out: list[tuple] = []
    for item, q_names, q_val in queries:
        at = np.searchsorted(names, q_names)
        found = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == q_names) if len(names) else np.zeros(len(q_names), bool)
        for score, row in tree.search(at[found], q_val[found], keys, k):
            out.append((item, doc_ids[row], keys[row][1], score))
    columns = list(zip(*out)) if out else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "_s_row", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents with a positive score for every item."""
    spark = docs.sparkSession
    importable(spark)
    docs = docs.select(F.col("doc_id"), F.col("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    q_terms = items.select("item_id", F.explode(terms_of(F.col("text"))).alias("_s_term"))
    # a query term is named by its 64-bit hash; that no two query terms share one is checked, so scores stay exact
    vocab = q_terms.select("_s_term").distinct().withColumn("_s_idx", F.xxhash64("_s_term")).cache()
    counts = vocab.agg(F.count(F.lit(1)).alias("terms"), F.countDistinct("_s_idx").alias("names")).first()
    if counts["terms"] != counts["names"]:
        raise ValueError("two query terms share a 64-bit hash")
    if counts["terms"] == 0:
        vocab.unpersist()
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    known = F.broadcast(vocab) if counts["terms"] <= VOCAB_BROADCAST else vocab
    tf = stored(term_frequencies(docs, known), "search-tf")
    sizes = tf.groupBy("_s_row").agg(F.max("_s_n").alias("n")).agg(
        F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")
    ).first()
    n_docs, n_terms = int(sizes["N"]), int(sizes["L"])
    tf = tf.filter(F.col("_s_idx").isNotNull())
    df = tf.groupBy("_s_idx").agg(F.count(F.lit(1)).alias("_s_df"))
    q_vec = (
        q_terms.join(known, "_s_term")
        .groupBy("item_id", "_s_term", "_s_idx")
        .agg(F.count(F.lit(1)).alias("_s_qc"))
        .join(df, "_s_idx")
        .select("item_id", "_s_idx", (F.col("_s_qc") * weight(n_docs, F.col("_s_df"))).alias("_s_q"))
        .groupBy("item_id")
        .agg(F.collect_list(F.struct("_s_idx", "_s_q")).alias("_s_q"))
    )
    m = F.lit(K1000 // 10 - B25) + F.expr(f"(25 * _s_n * {n_docs}L) div {max(n_terms, 1)}L")
    value = F.expr(f"({SCALE}L * _s_tf) div ({K1000}L * _s_tf + {M12}L * _s_m)")
    trees = max(partitions(spark), math.ceil(tf.count() / TREE_ENTRIES))
    vectors = (
        tf.withColumn("_s_m", m)
        .select("_s_row", "doc_id", "_s_idx", value.alias("_s_val"))
        .repartition(trees, "_s_row")
        .sortWithinPartitions("_s_row")
    )
    n_items = q_vec.count()
    blocks = max(1, math.ceil(n_items / QUERY_BLOCK))
    found = []
    for block in range(blocks):
        part = q_vec.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        queries = [(r["item_id"], np.array([x[0] for x in r["_s_q"]], np.int64), np.array([x[1] for x in r["_s_q"]], np.int64)) for r in part]
        sent = spark.sparkContext.broadcast(queries)

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches([b for b in batches if b.num_rows])
            if whole.num_rows:
                yield _searched(whole.combine_chunks(), sent.value, k)

        found.append(vectors.mapInArrow(each, "item_id long, doc_id long, _s_row long, score long"))
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_s_row"))
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "item_id", F.col("rank").cast("int"), "doc_id", "score"
    )


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), TOP)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rk,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sizes AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS nn, coalesce(sum(len(terms)), 0) AS ll FROM d
), q AS (
  SELECT item_id, term, count(*) AS qc
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), tf AS (
  SELECT rk, doc_id, n, term, count(*) AS tf
  FROM (SELECT rk, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q)
  GROUP BY rk, doc_id, n, term
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), scored AS (
  SELECT q.item_id, tf.rk, tf.doc_id,
         sum(q.qc * CAST(floor(1000.0 * ln((2.0 * sizes.nn + 2.0) / (2.0 * df.df + 1.0))) AS BIGINT)
             * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * sizes.nn) // sizes.ll)))) AS score
  FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = q.term CROSS JOIN sizes
  GROUP BY q.item_id, tf.rk, tf.doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored WHERE score > 0
) WHERE rank <= 20
"""
