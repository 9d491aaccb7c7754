"""Keyword search by postings against the plain filter over texts."""

import pytest

from docrecords.operators import lookup as L
from docrecords.operators import postings as PO

ROWS = [
    ("a", "Click here", "to win 42 prizes"),
    ("b", "click", "(42)! Déjà vu"),
    ("c", None, "42 clicks"),
    ("d", "", None),
    ("e", "Click 42", "42"),
    ("e", "again", "click 42"),
    (None, "click", "42"),
    ("f", "the THE the", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "objectID string, hierarchy_lvl0 string, content string")


@pytest.fixture(scope="module")
def index(docs):
    return PO.build(docs)


@pytest.mark.parametrize("query", ["Click, (42)!", "the", "déjà", "click nothere", "42", "CLICKS", "", "!!"])
def test_equals_the_plain_filter(docs, index, query):
    def key(row):
        return tuple("" if v is None else v for v in row)

    got = sorted(map(tuple, PO.with_all_words(docs, index, query).collect()), key=key)
    # a document without a key has no postings; a query without words keeps every document
    plain = L.with_words(docs, query, ["hierarchy_lvl0", "content"]).collect()
    want = sorted((tuple(r) for r in plain if r["objectID"] is not None or query.strip("!") == ""), key=key)
    assert got == want


def test_terms_count_documents(spark, index):
    df = {r["term"]: r["df"] for r in index.terms(spark).collect()}
    assert df["click"] == 3 and df["42"] == 4 and df["the"] == 1


def test_missing_word_reads_no_postings(spark, index):
    keys = PO.matching_keys(index, spark, "click absentword")
    assert keys.count() == 0 and "postings" not in keys.inputFiles().__str__()
