"""Input tables and specs for the example queries in ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecords.operators import page_attrs as P
from docrecords.operators.hierarchy import fill_down
from docrecords.operators.index import index_docs
from docrecords.plans.records import build_records, shape_records
from docrecords.sources.pages import read_pages
from docrecords.spec import CONTENT, LEVELS, Spec

LANGS = ("en", "fr", "de", "es")

PAGE_RULES = [
    {"url": rf"https?://[^/]+/{lang}/", "tags": [lang], "page_rank": len(LANGS) - rank}
    for rank, lang in enumerate(LANGS)
]
PAGE_SPEC = Spec.of(index_uid="pages", start_urls=PAGE_RULES, selectors={"lvl0": "h1", "content": "p"})

EVENT_RULES = [
    {"url": "https://events.example.com/en/", "page_rank": 2, "tags": ["en"]},
    {"url": "https://events.example.com/fr/", "page_rank": 1, "tags": ["fr"]},
]
EVENT_SELECTORS = {**{name: f"h{k + 1}" for k, name in enumerate(LEVELS)}, "content": "p"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_pages(spark, f"{folder}/pages.parquet")


def page_docs(spark: SparkSession, folder: str, spec: Spec = PAGE_SPEC) -> DataFrame:
    return index_docs(build_records(pages(spark, folder), spec))


def event_spec(selectors: dict | None = None, **config) -> Spec:
    return Spec.of(
        {"index_uid": "events", "start_urls": EVENT_RULES, "selectors": {**EVENT_SELECTORS, **(selectors or {})}, **config}
    )


def event_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Events as matched rows: a user is a page, the event id gives order and level."""
    user, event = F.col("user_id"), F.col("event_id")
    lang = F.when(user % 2 == 0, F.lit("en")).otherwise(F.lit("fr"))
    text = F.when(event % 5 != 0, F.concat_ws(" ", "event_type", (event % 97).cast("string")))
    anchored = (event % 3 == 0) & (event % 8 < CONTENT)
    return table(spark, folder, "events").select(
        user.alias("page_id"),
        F.concat(F.lit("https://events.example.com/"), lang, F.lit("/"), user.cast("string")).alias("url"),
        event.alias("nid"),
        (event % 8).cast("int").alias("lvl"),
        text.alias("text"),
        F.when(anchored, F.concat(F.lit("a"), (event % 31).cast("string"))).alias("anchor"),
    )


def filled_events(spark: SparkSession, folder: str) -> DataFrame:
    return fill_down(event_matches(spark, folder), ["page_id"], "nid", large=True, position="position")


def event_records(spark: SparkSession, folder: str, spec: Spec, page_globals: Column | None = None) -> DataFrame:
    url = F.col("url")
    columns = {
        "page_rank": P.page_rank(url, spec.start_urls),
        "tags": P.page_tags(url, spec.start_urls),
        "extras": P.empty_map(),
        "bare_url": url,
    }
    if page_globals is not None:
        columns["globals"] = page_globals
    return shape_records(filled_events(spark, folder).withColumns(columns), spec, filled=True)


def event_docs(spark: SparkSession, folder: str) -> DataFrame:
    return index_docs(event_records(spark, folder, event_spec({"lvl0": {"selector": "h1", "default_value": "Events"}})))
