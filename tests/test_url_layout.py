"""An index stored by URL: prefix reads open few files, partial updates leave untouched files as they are."""

import hashlib
from urllib.parse import urlparse

import pytest

from docrecords.operators import index as I
from docrecords.operators import url_layout as U

SCHEMA = "objectID string, url string, content string"


def digest(file):
    return hashlib.sha256(open(urlparse(file).path, "rb").read()).hexdigest()


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(U, "FILE_ROWS", 4)


def docs(spark):
    rows = [(f"id{i:02d}", f"https://s.example/{p}/{i:02d}", f"text {i}") for i, p in enumerate(["a", "b", "c", "d", "e"] * 6)]
    return spark.createDataFrame(rows + [("nourl", None, "x")], SCHEMA)


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


def test_partial_update_rewrites_only_touched_files(spark, tmp_path, small_files):
    root = str(tmp_path / "index")
    old = docs(spark)
    U.write(old, root)
    before = {r["file"]: digest(r["file"]) for r in U.current(spark, root).collect()}
    assert len(before) >= 6
    new = spark.createDataFrame([("id01", "https://s.example/b/01", "changed"), ("zz", "https://s.example/b/99", "added")], SCHEMA)
    written = U.partial_update(spark, root, new, ["https://s.example/c/"])
    after = {r["file"]: digest(r["file"]) for r in U.current(spark, root).collect()}
    untouched = set(before) & set(after)
    assert untouched and all(before[f] == after[f] for f in untouched)
    assert set(after) == untouched | set(written)
    # each touched file held a URL below the prefix or the id of a new document; the untouched ones held neither
    for f in before:
        rows = spark.read.parquet(f).collect()
        hit = any(r["objectID"] in ("id01", "zz") or (r["url"] or "").startswith("https://s.example/c/") for r in rows)
        assert hit == (f not in untouched)
    assert as_set(U.read(spark, root)) == as_set(I.partial_update(old, new, ["https://s.example/c/"]))


def test_prefix_read_opens_matching_files(spark, tmp_path, small_files):
    root = str(tmp_path / "index")
    U.write(docs(spark), root)
    got = U.read_prefix(spark, root, "https://s.example/d/")
    assert sorted(r["objectID"] for r in got.collect()) == [f"id{i:02d}" for i in range(3, 30, 5)]
    assert len(got.inputFiles()) < len(U.current(spark, root).collect())
    assert U.read_prefix(spark, root, "https://nothing/").count() == 0


def test_empty_index_and_update_to_nothing(spark, tmp_path):
    root = str(tmp_path / "index")
    U.write(spark.createDataFrame([], SCHEMA), root)
    assert U.read(spark, root).count() == 0
    assert U.read_prefix(spark, root, "https://").count() == 0
    root2 = str(tmp_path / "index2")
    U.write(spark.createDataFrame([("a", "https://x/1", "t")], SCHEMA), root2)
    U.partial_update(spark, root2, spark.createDataFrame([], SCHEMA), ["https://x/"])
    assert U.read(spark, root2).count() == 0
