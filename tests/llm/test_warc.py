import hashlib
import os

import duckdb
import pandas as pd
import zstandard
from pyspark.sql import functions as F
from helpers import LARGER, TESTDATA

from docrecords.llm import warc as W

PAGE = "<html><body>" + "a page that is long enough to be a revisit " * 4 + "</body></html>"


def test_round_trip_of_one_archive():
    payloads = [f"<p>{i} {'x' * i}</p>\r\n\r\nWARC/1.1 inside %0A".encode() for i in range(300)]
    records = [W.warc_record(i, f"http://h/{i}\n%", p, hashlib.sha256(p).hexdigest(), "response", None) for i, p in enumerate(payloads)]
    frames = W.compress_archive(records)
    assert frames[0][:4] == (0x184D2A50).to_bytes(4, "little") and len(frames[0]) > 8  # a dictionary was trained
    # the file is the frames in order; zstd skips the leading frame by itself
    whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frames[0][8:])).decompressobj()
    assert whole.decompress(frames[1]) == records[0]
    back = list(W.read_archive(frames))
    assert [r["page_id"] for r in back] == list(range(300))
    assert [r["url"] for r in back] == [f"http://h/{i}\n%" for i in range(300)]
    assert all(r["payload_bytes"] == len(p) for r, p in zip(back, payloads))


def test_tiny_archive_without_dictionary():
    frames = W.compress_archive([W.warc_record(None, None, b"", hashlib.sha256(b"").hexdigest(), "response", None)])
    assert frames[0] == (0x184D2A50).to_bytes(4, "little") + bytes(4)
    (only,) = W.read_archive(frames)
    assert only["page_id"] is None and only["payload_bytes"] == 0 and only["url"] == ""


def test_types_and_references(spark):
    rows = [(5, "u5", PAGE), (3, "u3", PAGE), (3, "u3", PAGE), (None, None, PAGE), (7, "u7", "short"), (8, "u8", "short"),
            (9, None, None), (10, "u10", ""), (11, "u11", "é" * 60), (12, "u12", "é" * 60), (13, "u13", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_w_payload", F.lit("a clashing extra column"))
    got = W.read_archives(W.write_archives(pages)).toPandas()
    by = {(r.page_id if pd.notna(r.page_id) else None, i): r for i, r in enumerate(got.itertuples())}
    kinds = sorted((k[0] if k[0] is not None else -1, r.record_type, r.refers_to if pd.notna(r.refers_to) else None) for k, r in by.items())
    assert kinds == sorted([
        (-1, "revisit", 3), (3, "response", None), (3, "response", None), (5, "revisit", 3), (7, "response", None),
        (8, "response", None), (9, "response", None), (10, "response", None), (11, "response", None), (12, "revisit", 11),
        (13, "response", None),
    ], key=lambda t: (t[0], t[1]))
    sizes = dict(zip(got["page_id"].fillna(-1), got["payload_bytes"]))
    assert sizes[11] == 120 and sizes[13] == 200_000 and sizes[9] == 0
    assert set(got.loc[got.page_id == 12, "payload_digest"]) == {hashlib.sha256(("é" * 60).encode()).hexdigest()}


def test_query_equals_sql(spark):
    for folder in (TESTDATA, LARGER):
        got = W.op13_warc(spark, folder).toPandas().sort_values("page_id").reset_index(drop=True)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{os.path.join(folder, 'pages')}.parquet'")
        want = con.execute(W.ORACLE_SQL).df().sort_values("page_id").reset_index(drop=True)
        assert len(got) == len(want) > 0
        for c in ("page_id", "payload_bytes", "refers_to"):
            assert got[c].astype("Int64").fillna(-1).equals(want[c].astype("Int64").fillna(-1)), c
        for c in ("payload_digest", "record_type"):
            assert got[c].equals(want[c]), c


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.op13_warc.__name__ and W.read_archives(W.write_archives(pages)).count() == 0
