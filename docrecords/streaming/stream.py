"""Pages arriving over time to an index that is kept up to date.

Selection is page-local and a page arrives whole, so the batch plan runs unchanged on every micro-batch. State is only
needed to know which URLs were seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docrecords.functions.urls import fingerprint
from docrecords.operators.crawl import first_by
from docrecords.operators.index import index_docs, published, read_index, rebuild
from docrecords.plans.records import build_records
from docrecords.spec import Spec

PAGE = "page_id long, url string, html string"


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(batch: DataFrame, batch_id: int, path: str, use_anchors: bool = False, order: str = "page_id", remember: int | None = None) -> DataFrame:
    """The pages of a micro-batch whose URL did not come before, in this or an earlier batch; for ``foreachBatch``.

    Of copies in one batch the first by ``order`` stays; the rank filter runs before the shuffle, so a frequent URL sends one
    page per task. Fingerprints that were seen lie in ``path``, a folder per batch: a batch that runs again replaces its own
    and is compared with earlier ones only. ``remember`` bounds them to that many batches. Pages with a null URL are compared
    with nothing and stay.
    """
    spark = batch.sparkSession
    pages = batch.withColumn("_fp", fingerprint(F.col("url"), use_anchors=use_anchors))
    key = F.coalesce("_fp", F.concat(F.lit("page "), F.col("page_id").cast("string")))
    pages = first_by(pages.withColumn("_fp", key), F.col("_fp"), [F.col(order)])
    # batch -1 is always there and empty, so the first batch has something to read
    spark.createDataFrame([], "_fp string").write.mode("overwrite").parquet(f"{path}/batch=-1")
    seen = spark.read.schema("_fp string, batch long").parquet(path).filter(F.col("batch") < batch_id)
    if remember is not None:
        seen = seen.filter(F.col("batch") >= batch_id - remember)
    fresh = pages.join(seen.select("_fp"), "_fp", "left_anti")
    fresh.select("_fp").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    # compared with the same earlier batches, so it is the same rows however often it is read
    return fresh.drop("_fp")


def stream_records(
    pages: DataFrame, spec: Spec, write: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, seen: str | None = None, **trigger
) -> StreamingQuery:
    """Run the batch plan on every micro-batch and hand its index documents to ``write(docs, pages, batch_id)``.

    With ``seen``, a folder for fingerprints, pages whose URL came before are dropped.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if seen is not None:
            batch = first_seen(batch, batch_id, seen, spec.use_anchors)
        write(index_docs(build_records(batch, spec)), batch.select("page_id"), batch_id)

    return (
        pages.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def batch_writer(path: str) -> Callable[[DataFrame, DataFrame, int], None]:
    """Write the documents and the page ids of every micro-batch; a batch that runs again replaces what it wrote."""

    def write(docs: DataFrame, pages: DataFrame, batch_id: int) -> None:
        docs.write.mode("overwrite").parquet(f"{path}/docs/batch={batch_id}")
        pages.write.mode("overwrite").parquet(f"{path}/pages/batch={batch_id}")

    return write


def current_docs(spark: SparkSession, path: str) -> DataFrame:
    """The index after all batches: of every page the documents of its latest batch, and none of older ones.

    Only the compacted version and the batches after it are read.
    """
    docs, pages = (spark.read.parquet(f"{path}/{part}") for part in ("docs", "pages"))
    done = published(spark, f"{path}/compact")
    if done is not None:
        # a compacted version is numbered one above its last batch
        docs, pages = docs.filter(F.col("batch") >= done), pages.filter(F.col("batch") >= done)
    latest = pages.groupBy("page_id").agg(F.max("batch").alias("batch"))
    fresh = docs.join(latest, ["page_id", "batch"], "left_semi").drop("batch")
    if done is None:
        return fresh
    old = read_index(spark, f"{path}/compact").join(latest, "page_id", "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def compact(spark: SparkSession, path: str) -> None:
    """Publish the index after all batches as one version, from which reads then start. Batches stay until they are removed
    by whoever owns the folder. Not to be run while a batch is written."""
    upto = spark.read.parquet(f"{path}/pages").agg(F.max("batch")).first()[0]
    rebuild(current_docs(spark, path), f"{path}/compact", upto + 1)
