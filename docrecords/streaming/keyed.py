"""First pages of a stream by URL fingerprint, with keyed state instead of a read of all history.

Every fingerprint is a key of the stream's state store (RocksDB): one small value state per fingerprint says it was seen.
A micro-batch groups its pages by fingerprint; a key without state emits the first of its pages by ``order`` and sets the
state, a key with state emits nothing. So a batch reads the state of its own keys only, whatever the length of the run, and a
batch that runs again after a failure sees the state as it was before it (the state store is versioned with the
checkpoint). ``ttl_ms`` lets a fingerprint be forgotten after that long without being seen again (processing time).

Defined results: pages with a null URL are keyed by their page_id and stay; pages that share a fingerprint and the least
``order`` in one batch keep the one of the least page_id; an empty stream gives nothing. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StringType, StructType

from docrecords.functions.urls import fingerprint

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    def __init__(self, order: str, ttl_ms: int | None, columns: list[str]):
        self.order, self.ttl_ms, self.columns = order, ttl_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pages = pd.concat(list(rows), ignore_index=True)
        if self.seen.exists():
            return
        first = pages.sort_values([self.order, "page_id"], kind="stable", na_position="last").head(1)
        self.seen.update((True,))
        # the key is not among the columns handed over
        yield first.assign(_fp=key[0])[self.columns]

    def close(self) -> None:
        pass


def first_seen_keyed(pages: DataFrame, order: str = "page_id", use_anchors: bool = False, ttl_ms: int | None = None) -> DataFrame:
    """The pages of a streaming DataFrame whose fingerprint (column ``_fp``) did not come in an earlier page."""
    spark = pages.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    key = F.coalesce(fingerprint(F.col("url"), use_anchors=use_anchors), F.concat(F.lit("page "), F.col("page_id").cast("string")))
    keyed = pages.withColumn("_fp", key)
    out = StructType([f for f in pages.schema.fields if f.name != "_fp"] + [StructField("_fp", StringType())])
    return keyed.groupBy("_fp").transformWithStateInPandas(
        statefulProcessor=FirstOfKey(order, ttl_ms, out.fieldNames()),
        outputStructType=out,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms is not None else "None",
    )
