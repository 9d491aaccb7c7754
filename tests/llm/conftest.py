import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers import TESTDATA

#: texts with nulls, empty and blank ones, ties, repeated rows and a very long one
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "one two"),
    (6, "A b  c\td\x0be"),
    (6, "A b  c\td\x0be"),
    (7, "a b c d e"),
    (8, "é\xa0ü 日本  x 😀 </s>[INST] ▁ \x85"),
    (None, "no id here at all"),
    (9, "word " * 3000 + "end"),
    (10, "z" * 5000),
]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1.5, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string")


@pytest.fixture
def none(odd):
    return odd.limit(0)


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{TESTDATA}/documents.parquet")


@pytest.fixture
def labels(spark):
    return spark.read.parquet(f"{TESTDATA}/labels.parquet")
