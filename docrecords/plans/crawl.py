"""A whole run over stored pages: seeds, reachable pages, sitemap pages, deduplication, records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docrecords.functions.urls import canonical, drop_bare_fragment, drop_params
from docrecords.operators import crawl as C
from docrecords.operators.decompose import decompose, page_links
from docrecords.operators.index import index_docs, partial_update
from docrecords.plans.records import build_records
from docrecords.sources.sitemap import crawl_sitemaps
from docrecords.spec import Spec


def clean_responses(pages: DataFrame, spec: Spec) -> DataFrame:
    """Response URLs as they are compared later; pages without ``request_url`` were not redirected."""
    if "request_url" not in pages.columns:
        pages = pages.withColumn("request_url", F.col("url"))
    # links are resolved against the response as it came
    pages = pages.withColumn("_response_url", F.col("url"))
    if spec.remove_get_params:
        pages = pages.withColumn("url", drop_params(F.col("url")))
    return pages.withColumn("url", drop_bare_fragment(F.col("url"), F.col("request_url")))


def link_table(pages: DataFrame) -> DataFrame:
    """Links of cleaned pages. A crawl knows a page by the URL it asked for, wherever the answer came from."""
    return page_links(decompose(pages.select("request_url", "_response_url", "html")), "_response_url", "request_url")


def select_pages(
    pages: DataFrame, spec: Spec, sitemaps: DataFrame | None = None, links: DataFrame | None = None
) -> DataFrame:
    """The stored pages that a run with this spec turns into records, with ``from_sitemap``.

    ``pages(page_id, url, html)``, optionally ``request_url``, ``status`` and the flag ``redirected``.
    """
    pages = clean_responses(pages, spec)
    start = C.seeds(pages.sparkSession, spec).filter("kind = 'page'").select("url")
    if "status" in pages.columns:
        answers = pages.select(F.col("request_url").alias("url"), "status")
        start = C.with_fallback(start, answers).select(F.coalesce("fetched_url", "url").alias("url"))
        pages = pages.filter("status < 400")
    links = link_table(pages) if links is None else links
    reached = C.crawl_closure(links, start, spec).select(F.col("node").alias("_node"))
    node = F.col("request_url") if spec.use_anchors and spec.js_render else canonical(F.col("request_url"))
    crawled = C.record_pages(pages.join(reached, node == F.col("_node"), "left_semi"), spec)
    listed = pages.filter(F.lit(False))
    if spec.sitemap_urls and sitemaps is not None and not spec.only_urls:
        urls = crawl_sitemaps(sitemaps, list(spec.sitemap_urls), spec.sitemap_alternate_links)
        urls = urls.select(canonical(F.col("url")).alias("_node")).distinct()
        asked = canonical(F.col("request_url")) == F.col("_node")
        listed = C.sitemap_pages(pages.join(urls, asked, "left_semi"), spec)
    flagged = "redirected" if "redirected" in pages.columns else None
    return C.page_set(listed, crawled, flagged=flagged, use_anchors=spec.use_anchors).drop("_response_url")


def run(
    pages: DataFrame, spec: Spec, sitemaps: DataFrame | None = None, links: DataFrame | None = None
) -> DataFrame:
    """Stored pages to records, up to the page that crosses the cap on records."""
    records = build_records(select_pages(pages, spec, sitemaps, links), spec)
    if spec.nb_hits_max == 0:
        return records
    # counted and then read again: written once instead of built twice
    C.checkpoint_dir(pages.sparkSession)
    records = records.checkpoint()
    per_page = records.groupBy("page_id", "from_sitemap").agg(F.count(F.lit(1)).alias("records"))
    return C.cap_records(records, per_page, spec.nb_hits_max)


def refreshed_index(stored: DataFrame, records: DataFrame, spec: Spec) -> DataFrame:
    """The index after a run: only what lies below ``only_urls`` is replaced when they are given, else everything."""
    docs = index_docs(records)
    return partial_update(stored, docs, spec.only_urls) if spec.only_urls else docs
