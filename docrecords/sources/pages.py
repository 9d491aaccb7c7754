"""Page sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_body(body: Column) -> Column:
    """Bytes to text: UTF-8 where valid, else byte by byte."""
    return F.coalesce(F.try_validate_utf8(body.cast("string")), F.decode(body, "ISO-8859-1"))


# a scan of at most this many splits may be dealt out anew: a few gigabytes
SMALL = 32


def spread(pages: DataFrame) -> DataFrame:
    """Give a scan of a few small files enough partitions for the cores at hand; larger scans are left alone.

    Parsing is the heavy step and runs in the scan's partitions. Use it on plain scans: asking for the number of
    partitions of a plan with shuffles would run them.
    """
    splits = pages.rdd.getNumPartitions()
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if splits < min(cores, SMALL) else pages


def decode_pages(pages: DataFrame, body: str = "body", encoding: str = "encoding", html: str = "html") -> DataFrame:
    """Replace the bytes of ``body`` by text: in the declared ``encoding`` where there is one that is known and fits, else
    UTF-8 where valid, else byte by byte. Null bytes give null."""
    carried = [f for f in pages.schema.fields if f.name not in (body, encoding, html)]
    names = [f.name for f in carried]

    def text(data: bytes | None, declared: str | None) -> str | None:
        if data is None:
            return None
        for name in (declared, "utf-8"):
            try:
                return data.decode(name) if name else data.decode("utf-8")
            except (LookupError, UnicodeDecodeError):
                continue
        return data.decode("latin-1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = dict(zip(batch.schema.names, batch.columns))
            texts = [text(d, e) for d, e in zip(held[body].to_pylist(), held[encoding].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(held[n] for n in names), pa.array(texts, pa.string())], names=[*names, html])

    return pages.mapInArrow(run, T.StructType([*carried, T.StructField(html, T.StringType())]))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, html`` from Parquet; only these columns are read."""
    return spread(spark.read.parquet(path).select("page_id", "url", "html"))


def read_html_files(spark: SparkSession, glob: str) -> DataFrame:
    """Files as pages; the path is the URL and its hash the id. Empty files give no page."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select(
        F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), decode_body(F.col("content")).alias("html")
    )


def read_text_files(spark: SparkSession, glob: str) -> DataFrame:
    files = spark.read.text(glob, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(F.xxhash64(path).alias("page_id"), path.alias("url"), F.col("value").alias("html"))
