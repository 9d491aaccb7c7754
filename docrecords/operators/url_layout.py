"""An index stored by URL: range-sorted files and a manifest of the URLs each file holds.

``write`` deals the documents into URL ranges (``repartitionByRange``), sorts each range and writes it; a manifest row per
file gives its smallest and largest URL and its rows. Manifests are numbered; the largest number is the current state,
and a file that a manifest names is never changed afterwards. The schema is kept in an empty file of its own.

``read_prefix`` opens only the files whose URL range can hold the prefix. ``partial_update`` deletes what is stored below
some URL prefixes and upserts new documents by objectID: the files it touches are those whose range meets a prefix and
those holding an objectID of a new document (found by a scan of the objectID column only); only these are read and
written again, and the next manifest names the untouched files as they are plus the new ones.

Defined results: an index may hold no documents; documents with a null URL sort first and are never below a prefix; an empty update leaves the manifest
as it is (a new number, the same files); new documents that share an objectID keep the one of the largest hash of its
plain columns (as ``index.upsert`` does). Working columns start with ``_u_``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.operators.index import prefix_test, upsert

#: rows a file holds on average
FILE_ROWS = 200_000
MANIFEST = "number long, file string, min_url string, max_url string, rows long"


def _files(docs: DataFrame, root: str) -> DataFrame:
    """Write ``docs`` as range-sorted files under a new folder; their manifest rows (without a number)."""
    spark = docs.sparkSession
    folder = f"{root}/files/{uuid.uuid4().hex}"
    rows = docs.count()
    if rows == 0:
        return spark.createDataFrame([], "file string, min_url string, max_url string, rows long")
    parts = max(1, -(-rows // FILE_ROWS))
    docs.repartitionByRange(parts, F.col("url").asc_nulls_first()).sortWithinPartitions(F.col("url").asc_nulls_first()).write.parquet(folder)
    written = spark.read.parquet(folder).select(F.input_file_name().alias("file"), "url")
    return written.groupBy("file").agg(F.min("url").alias("min_url"), F.max("url").alias("max_url"), F.count(F.lit(1)).alias("rows"))


def current(spark: SparkSession, root: str) -> DataFrame:
    manifests = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    latest = manifests.agg(F.max("number")).first()[0]
    return manifests.filter((F.col("number") == latest) & F.col("file").isNotNull())


def _publish(spark: SparkSession, root: str, entries: DataFrame, number: int) -> None:
    """Append the manifest of state ``number``; a row without a file marks the state, also when it names no file."""
    marker = spark.createDataFrame([(None, None, None, 0)], "file string, min_url string, max_url string, rows long")
    entries = entries.select("file", "min_url", "max_url", "rows").unionByName(marker)
    entries.select(F.lit(number).cast("long").alias("number"), "file", "min_url", "max_url", "rows").coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def write(docs: DataFrame, root: str) -> None:
    """The first state of an index at ``root``."""
    docs.limit(0).write.parquet(f"{root}/schema")
    _publish(docs.sparkSession, root, _files(docs, root), 1)


def _read(spark: SparkSession, files: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def schema_of(spark: SparkSession, root: str):
    return spark.read.parquet(f"{root}/schema").schema


def read(spark: SparkSession, root: str) -> DataFrame:
    files = [r["file"] for r in current(spark, root).select("file").collect()]
    return _read(spark, files, schema_of(spark, root))


def _meets(prefixes: Sequence[str]) -> F.Column:
    """A file's range can hold a URL below one of the prefixes."""
    tests = [(F.col("max_url") >= F.lit(p)) & (F.col("min_url") <= F.concat(F.lit(p), F.lit("\U0010ffff"))) for p in prefixes]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def read_prefix(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """Documents whose URL starts with ``prefix``; only files whose range meets it are opened."""
    manifest = current(spark, root)
    files = [r["file"] for r in manifest.filter(_meets([prefix])).select("file").collect()]
    schema = schema_of(spark, root)
    return _read(spark, files, schema).filter(F.startswith("url", F.lit(prefix)))


def partial_update(spark: SparkSession, root: str, new: DataFrame, prefixes: Sequence[str]) -> list[str]:
    """Replace what is below ``prefixes`` and upsert ``new``; returns the files written anew (none if nothing changed)."""
    manifest = current(spark, root)
    number = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").agg(F.max("number")).first()[0]
    every = [r["file"] for r in manifest.select("file").collect()]
    schema = schema_of(spark, root)
    by_range = {r["file"] for r in manifest.filter(_meets(prefixes)).select("file").collect()} if prefixes else set()
    ids = _read(spark, every, schema).select("objectID", F.input_file_name().alias("_u_file"))
    by_id = {r["_u_file"] for r in ids.join(new.select("objectID").distinct(), "objectID", "left_semi").select("_u_file").distinct().collect()}
    touched = sorted(by_range | by_id)
    kept = manifest.filter(~F.col("file").isin(touched)) if touched else manifest
    old = _read(spark, touched, schema)
    old = old.filter(~prefix_test(F.col("url"), list(prefixes))) if prefixes else old
    changed = upsert(old, new.select(*schema.fieldNames())).select(*schema.fieldNames())
    fresh = _files(changed, root) if touched or not new.isEmpty() else None
    entries = kept.select("file", "min_url", "max_url", "rows")
    if fresh is not None:
        entries = entries.unionByName(fresh.filter(F.col("rows") > 0))
    _publish(spark, root, entries, number + 1)
    return [] if fresh is None else [r["file"] for r in fresh.select("file").collect()]
