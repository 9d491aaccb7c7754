import os
from itertools import product

import duckdb
import numpy as np
import pytest
from helpers import TESTDATA

from docrecords.llm import filter_audit as A


@pytest.mark.parametrize("seed", range(6))
def test_gray_states_equal_direct_counts(seed):
    rng = np.random.default_rng(seed)
    masks = rng.integers(0, 32, 40)
    counts = rng.integers(0, 9, 40)
    good, toxic = rng.integers(0, 2, 40), rng.integers(0, 2, 40)
    states = A.gray_states(masks, counts, good, toxic)
    for subset in range(32):
        alive = (masks & subset) == 0
        assert list(states[subset]) == [counts[alive].sum(), (counts * good)[alive].sum(), (counts * toxic)[alive].sum()]


def test_query_equals_sql(spark):
    got = A.op12_filter_audit(spark, TESTDATA).toPandas()
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(TESTDATA, name)}.parquet'")
    want = con.execute(A.ORACLE_SQL).df()
    key = ["part", "filter_order", "step"]
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert len(got) == 600 * got["part"].nunique() > 0
    assert got[key].astype(str).equals(want[key].astype(str))
    for c in A.SCHEMA_NAMES[3:]:
        assert (got[c].astype("int64") == want[c].astype("int64")).all(), c


def test_odd_rows(spark, odd):
    docs = odd.withColumn("source", odd["doc_id"] % 2).withColumn("lang", odd["text"])  # clashing extra columns
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 1), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = A.audit(docs, labels).collect()
    parts = {r["part"] for r in rows}
    assert parts == {"0", "1", ""}  # null id gives a null source, the part ""
    assert len(rows) == 600 * 3
    for part, order in product(parts, A.ORDERS):
        steps = sorted((r for r in rows if r["part"] == part and r["filter_order"] == order), key=lambda r: r["step"])
        total = steps[0]["kept"] + steps[0]["removed"]
        assert sum(r["removed"] for r in steps) + steps[-1]["kept"] == total
    # all but the long text of id 9 (odd part) have under 50 words, so A first keeps that one only
    first_a = [r for r in rows if r["filter_order"].startswith("A") and r["step"] == 1]
    assert all(r["kept"] == (1 if r["part"] == "1" else 0) for r in first_a)
    # both rows of id 6 are good (one label says so) and toxic (the other does); they fail A
    even = [r for r in rows if r["part"] == "0" and r["filter_order"] == "ABCDE" and r["step"] == 1][0]
    assert even["good_lost"] == 2 and even["toxic_lost"] == 2
    # shapley: each filter's removed summed over the 120 orders, the same in all its rows
    for part in parts:
        for x in A.LETTERS:
            mine = [r for r in rows if r["part"] == part and r["filter_order"][r["step"] - 1] == x]
            assert len({r["shapley"] for r in mine}) == 1 and mine[0]["shapley"] == sum(r["removed"] for r in mine)


def test_duplicates_make_e(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "s"), (2, text, "t"), (2, text, "t"), (3, None, "s"), (4, "", "s"), (None, text, "s")], "doc_id long, text string, source string")
    rows = {(r["part"], r["filter_order"], r["step"]): r for r in A.audit(docs).collect()}
    # E first: in part t both rows of id 2 repeat id 1's text (part s); in s the empty id 4 repeats null id 3
    assert rows[("t", "EABCD", 1)]["removed"] == 2
    assert rows[("s", "EABCD", 1)]["removed"] == 1
    assert rows[("s", "EABCD", 1)]["unique_fails"] == 0


def test_empty(spark, none):
    assert A.audit(none).count() == 0
