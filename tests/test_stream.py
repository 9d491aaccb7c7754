"""Streams give what the batch plan gives."""

from docrecords import Spec, build_records
from docrecords.operators.index import index_docs
from docrecords.streaming import stream

SPEC = Spec.of(index_uid="t", start_urls=["http://a.b/"], selectors={"lvl0": "h1", "content": "p"})


def page(i, text):
    return (i, f"http://a.b/{i}", f"<h1>T{i}</h1><p>{text}</p>")


def docs(df):
    return sorted((r.page_id, r.type, r.hierarchy_lvl0, r.content, r.objectID) for r in df.collect())


def test_stream_equals_batch_and_reruns_are_harmless(spark, tmp_path):
    source, index, state, seen = (str(tmp_path / n) for n in ("in", "index", "state", "seen"))
    write = stream.batch_writer(index)

    def step(rows):
        spark.createDataFrame(rows, stream.PAGE).coalesce(1).write.mode("append").parquet(source)
        stream.stream_records(stream.page_stream(spark, source), SPEC, write, state, seen).awaitTermination()

    # of copies in a batch the first in order stays, whatever its scheme
    step([(9, "https://a.b/1", "<h1>copy</h1>"), page(1, "a"), page(2, "b"), (None, None, "<h1>no url</h1>")])
    # a page seen in an earlier batch is dropped, also under the other scheme
    step([page(3, "c"), (10, "https://a.b/2#x", "<h1>copy</h1>")])
    got = docs(stream.current_docs(spark, index))
    want = docs(index_docs(build_records(spark.createDataFrame([page(i, t) for i, t in ((1, "a"), (2, "b"), (3, "c"))], stream.PAGE), SPEC)))
    assert [r for r in got if r[0] is not None] == want

    # the same batch seen and written again leaves the same index
    batch = spark.createDataFrame([page(3, "c"), (10, "https://a.b/2#x", "<h1>copy</h1>")], stream.PAGE)
    again = stream.first_seen(batch, 1, seen)
    write(index_docs(build_records(again, SPEC)), again.select("page_id"), 1)
    assert docs(stream.current_docs(spark, index)) == got


def test_a_changed_page_leaves_no_old_document(spark, tmp_path):
    index = str(tmp_path / "index")
    write = stream.batch_writer(index)

    def step(batch_id, rows):
        pages = spark.createDataFrame(rows, stream.PAGE)
        write(index_docs(build_records(pages, SPEC)), pages.select("page_id"), batch_id)

    def texts():
        return sorted((r.page_id, r.content) for r in stream.current_docs(spark, index).collect() if r.content)

    step(0, [page(1, "old"), page(2, "kept"), page(3, "gone")])
    step(1, [page(1, "new"), (3, "http://a.b/3", "")])
    assert texts() == [(1, "new"), (2, "kept")]
    stream.compact(spark, index)
    assert texts() == [(1, "new"), (2, "kept")]
    step(2, [page(2, "later")])
    assert texts() == [(1, "new"), (2, "later")]
    stream.compact(spark, index)
    assert texts() == [(1, "new"), (2, "later")]


def test_bounded_memory_of_seen_pages(spark, tmp_path):
    seen = str(tmp_path / "seen")
    batch = spark.createDataFrame([page(1, "a")], stream.PAGE)
    counts = [stream.first_seen(batch, i, seen, remember=2).count() for i in range(5)]
    assert counts == [1, 0, 0, 1, 0]
