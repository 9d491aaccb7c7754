import os

import duckdb
import numpy as np
import pytest
from helpers import TESTDATA

from docrecords.llm import lexical_search as L


def brute(indptr, indices, values, q_idx, q_val, keys, k):
    q = np.zeros(max(indices.max(initial=0), q_idx.max(initial=0)) + 1, np.int64)
    np.add.at(q, q_idx, q_val)
    scored = []
    for row in range(len(indptr) - 1):
        s, e = indptr[row], indptr[row + 1]
        score = int(q[indices[s:e]] @ values[s:e])
        if score > 0:
            scored.append((-score, keys[row][0], keys[row][1], row))
    return [(-x[0], x[3]) for x in sorted(scored)[:k]]


@pytest.mark.parametrize("seed", range(12))
def test_tree_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    rows = int(rng.integers(1, 400))
    dim = int(rng.integers(1, 60))
    lengths = rng.integers(1, min(dim, 12) + 1, rows)
    indptr = np.concatenate([[0], np.cumsum(lengths)])
    indices = np.concatenate([np.sort(rng.choice(dim, n, replace=False)) for n in lengths])
    # few distinct values, so that equal scores and equal rows are common
    values = rng.integers(0, 4, len(indices)).astype(np.int64) * 250_000
    keys = [(int(d), r) for r, d in enumerate(rng.integers(0, rows // 3 + 1, rows))]
    tree = L.BallTree(indptr, indices, values, leaf=int(rng.integers(1, 9)))
    for _ in range(5):
        n = int(rng.integers(1, 8))
        q_idx = rng.integers(0, dim, n)
        q_val = rng.integers(1, 30_000, n).astype(np.int64)
        for k in (1, 3, 20):
            assert tree.search(q_idx, q_val, keys, k) == brute(indptr, indices, values, q_idx, q_val, keys, k)


def test_empty_tree():
    tree = L.BallTree(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert tree.search(np.array([1]), np.array([5]), [], 20) == []


def test_query_equals_sql(spark):
    got = L.op11_lexical_search(spark, TESTDATA).toPandas().sort_values(["item_id", "rank"]).reset_index(drop=True)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(TESTDATA, name)}.parquet'")
    want = con.execute(L.ORACLE_SQL).df().sort_values(["item_id", "rank"]).reset_index(drop=True)
    assert len(got) > 0
    cols = ["item_id", "rank", "doc_id", "score"]
    assert got[cols].astype("int64").equals(want[cols].astype("int64"))
    assert got.groupby("item_id")["rank"].max().le(20).all()


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "word end"), (2, None), (3, "B c"), (None, "z" * 5000), (4, "%%% ...")], "item_id long, text string")
    got = L.search(odd.withColumn("score", odd["doc_id"]), items).collect()
    by_item = {}
    for r in got:
        by_item.setdefault(r["item_id"], []).append(r)
    assert 2 not in by_item and 4 not in by_item  # no terms, nothing returned
    assert [r["doc_id"] for r in by_item[1]][:1] == [9]  # the long text holds both words many times
    # rows that share an id are both returned, next to each other
    assert sorted(r["doc_id"] for r in by_item[3]).count(6) == 2
    assert [r["doc_id"] for r in by_item[None]] == [10]
    for rows in by_item.values():
        assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1))
        scores = [r["score"] for r in sorted(rows, key=lambda r: r["rank"])]
        assert scores == sorted(scores, reverse=True) and min(scores) > 0


def test_empty(spark, none):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert L.search(none, items).count() == 0
    assert L.search(none, items.limit(0)).count() == 0
