"""First pages by fingerprint with keyed state: later batches see the keys of earlier ones, null URLs stay."""

from docrecords.streaming import keyed

SCHEMA = "page_id long, url string, html string"


def run(spark, src, root):
    kept = keyed.first_seen_keyed(src).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
    kept.trigger(availableNow=True).start().awaitTermination()
    return sorted(r.page_id for r in spark.read.parquet(f"{root}/out").collect())


def test_keys_outlive_batches(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(2, "http://a.example/x", "h"), (1, "https://a.example/x", "h"), (3, None, "h"), (4, None, "h"), (6, "http://b.example/", "h")], SCHEMA).write.parquet(f"{root}/in/1")
    src = spark.readStream.schema(SCHEMA).parquet(f"{root}/in/*")
    assert run(spark, src, root) == [1, 3, 4, 6]
    # a later batch: a smaller id of a known URL does not come back; a new URL does
    spark.createDataFrame([(0, "http://a.example/x", "h"), (5, "http://c.example/", "h")], SCHEMA).write.parquet(f"{root}/in/2")
    assert run(spark, src, root) == [1, 3, 4, 5, 6]
    # nothing new: nothing more
    assert run(spark, src, root) == [1, 3, 4, 5, 6]
