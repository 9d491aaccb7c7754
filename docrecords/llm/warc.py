"""WARC archives of pages with payload deduplication, compressed record by record with a dictionary of their own.

Spark decides the record types: the SHA-256 of every payload (the html in UTF-8) is grouped with a pre-aggregated
shuffle, and of the payloads of at least ``MIN_REVISIT`` bytes the page with the smallest page_id is written as a
``response``, every other one as a ``revisit`` that refers to it (identical-payload-digest profile, no payload).

Every task writes its rows as archives of at most ``ARCHIVE_BYTES`` uncompressed bytes. For each archive a Zstandard
dictionary is trained on a bounded, evenly spaced sample of its own records (``DICT_SAMPLE_BYTES``, a documented
parameter) and stored in a leading skippable frame; then every record is compressed by itself as one zstd frame with that
dictionary, so that a reader can start at any record once it has the first frame. An archive is stored as rows
``(archive, seq, frame)`` in the shared folder; its bytes in ``seq`` order are the ``.warc.zst`` file.

Reading groups the frames by archive (an archive is bounded by ``ARCHIVE_BYTES``), loads the dictionary from the skippable
frame and parses every record back.

Defined results: null html is an empty payload (always a response); a null url gives an empty target. Rows that share a
page_id and payload are all responses when that id is the smallest; a null page_id is never the smallest, so it revisits a
payload that a page with an id holds, and is a response otherwise. When too few or too small records allow no dictionary,
the skippable frame is empty and records are compressed without one. An empty table gives no archives and no rows. Extra
columns do not matter; working columns start with ``_w_``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.llm.common import importable, stored, table

# fixed values of the formats: WARC 1.1 and the first magic number of zstd's skippable frames
VERSION = b"WARC/1.1"
SKIPPABLE = 0x184D2A50
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
DICT_BYTES = 64 << 10
DICT_SAMPLE_BYTES = 8 << 20
LEVEL = 10
NAMESPACE = uuid.UUID("5a0c8a6e-3f0e-4f59-9a4b-6f3d1f0b2c11")

FRAMES = "archive long, seq long, frame binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive long, seq long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def _field(value: object) -> str:
    """A header value on one line: CR, LF and percent signs are escaped."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def http_head(length: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP head only."""
    block = http_head(len(payload)) + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _field(url or "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    return head + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.decode().split(": ", 1) for line in http.split(b"\r\n")[1:])["Content-Length"])
    kind = fields["WARC-Type"]
    if kind == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if len(payload) != length or f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError("payload does not match its digest")
    else:
        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = fields["X-Page-Id"]
    url = fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {
        "page_id": int(page) if page else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(fields["X-Refers-To-Page-Id"]) if kind == "revisit" and fields["X-Refers-To-Page-Id"] != "None" else None,
        "url": url,
    }


def skippable_frame(content: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(content)) + content


def compress_archive(records: list[bytes]) -> list[bytes]:
    """Frames of one archive: the dictionary in a skippable frame, then each record by itself."""
    total = sum(map(len, records))
    step = max(1, -(-total // DICT_SAMPLE_BYTES))
    sample = records[::step]
    try:
        dictionary = zstandard.train_dictionary(DICT_BYTES, sample) if len(sample) >= 8 else None
    except zstandard.ZstdError:
        dictionary = None
    content = dictionary.as_bytes() if dictionary is not None else b""
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary) if dictionary is not None else zstandard.ZstdCompressor(level=LEVEL)
    return [skippable_frame(content), *(compressor.compress(r) for r in records)]


def read_archive(frames: list[bytes]) -> Iterator[dict]:
    """Records of one archive from its frames in order."""
    magic, size = struct.unpack("<II", frames[0][:8])
    if magic != SKIPPABLE or size != len(frames[0]) - 8:
        raise ValueError("an archive starts with its dictionary in a skippable frame")
    content = frames[0][8:]
    dictionary = zstandard.ZstdCompressionDict(content) if content else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary is not None else zstandard.ZstdDecompressor()
    for frame in frames[1:]:
        yield parse_record(reader.decompress(frame))


def kinds(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest, record_type, refers_to)`` decided by grouping equal payloads."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("_w_payload"))
    rows = rows.select("*", F.sha2("_w_payload", 256).alias("_w_digest"), F.octet_length("_w_payload").alias("_w_bytes"))
    firsts = rows.filter(F.col("_w_bytes") >= MIN_REVISIT).groupBy("_w_digest").agg(F.min("page_id").alias("_w_first"))
    joined = rows.join(firsts, "_w_digest", "left")
    revisit = (F.col("_w_bytes") >= MIN_REVISIT) & F.col("_w_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("_w_first")))
    return joined.select(
        "page_id", "url", "_w_payload", "_w_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("_w_kind"),
        F.when(revisit, F.col("_w_first")).alias("_w_refers"),
    )


def write_archives(pages: DataFrame) -> DataFrame:
    """Frames of all archives, stored in the shared folder."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 24
        number, records, size = 0, [], 0

        def flush() -> pd.DataFrame:
            frames = compress_archive(records)
            return pd.DataFrame({"archive": base + number, "seq": range(len(frames)), "frame": frames})

        for batch in batches:
            for page, url, payload, digest, kind, refers in batch.itertuples(index=False):
                page = None if pd.isna(page) else int(page)
                refers = None if pd.isna(refers) else int(refers)
                record = warc_record(page, None if url is None or pd.isna(url) else url, bytes(payload), digest, kind, refers)
                if records and size + len(record) > ARCHIVE_BYTES:
                    yield flush()
                    number, records, size = number + 1, [], 0
                records.append(record)
                size += len(record)
        if records:
            yield flush()

    importable(pages.sparkSession)
    return stored(kinds(pages).mapInPandas(each, FRAMES), "warc")


def read_archives(frames: DataFrame) -> DataFrame:
    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        rows = list(read_archive([bytes(f) for f in group["frame"]]))
        out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        out["archive"] = key[0]
        out["seq"] = group["seq"].to_numpy()[1:]
        return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    importable(frames.sparkSession)
    return frames.groupBy("archive").applyInPandas(each, RECORDS)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH d AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
), typed AS (
  SELECT d.*, f.first_id,
         d.payload_bytes >= 100 AND f.first_id IS NOT NULL AND (d.page_id IS NULL OR d.page_id > f.first_id) AS revisit
  FROM d LEFT JOIN firsts f ON f.payload_digest = d.payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first_id END AS refers_to
FROM typed
"""
