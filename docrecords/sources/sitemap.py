"""Sitemaps as data: ``(url, xml)`` rows to page URLs.

Sitemaps come from everywhere and are often broken. They are read with patterns, so one bad file gives what it can and
never fails a job, which an XML parser would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docrecords.operators.crawl import reachable

_LOC = r"(?s)<(?:(?!image:|video:|news:)\w+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</"
# XML entities, the ampersand last.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _text(col: Column) -> Column:
    for entity, char in _ENTITIES.items():
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def _blocks(name: str) -> Column:
    """The elements of a name, as text; comments are left out."""
    plain = F.regexp_replace("xml", r"(?s)<!--.*?-->", "")
    return F.regexp_extract_all(plain, F.lit(rf"(?s)<(?:\w+:)?{name}[\s>].*?</(?:\w+:)?{name}\s*>"), F.lit(0))


def _locs(blocks: Column) -> Column:
    return F.filter(F.transform(blocks, lambda b: _text(F.regexp_extract(b, _LOC, 1))), lambda u: u != "")


def _alternates(block: Column) -> Column:
    links = F.regexp_extract_all(block, F.lit(r"(?s)<(?:\w+:)?link\b[^>]*>"), F.lit(0))
    wanted = F.filter(links, lambda t: t.rlike(r"""\brel\s*=\s*["']alternate["']"""))
    return F.transform(wanted, lambda t: _text(F.regexp_extract(t, r"""\bhref\s*=\s*["']([^"']*)["']""", 1)))


def sitemap_urls(sitemaps: DataFrame, alternate_links: bool = False) -> DataFrame:
    """Page URLs of the sitemaps: ``sitemap_url, ord, url``; alternate links only when asked for."""
    blocks = _blocks("url")
    found = _locs(blocks)
    if alternate_links:
        found = F.concat(found, F.flatten(F.transform(blocks, _alternates)))
    return sitemaps.select(F.col("url").alias("sitemap_url"), F.posexplode(found).alias("ord", "url"))


def nested_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Sitemaps that an index of sitemaps points to: ``index_url, url``."""
    return sitemaps.select(F.col("url").alias("index_url"), F.explode(_locs(_blocks("sitemap"))).alias("url"))


def crawl_sitemaps(sitemaps: DataFrame, seeds: list[str], alternate_links: bool = False) -> DataFrame:
    """Page URLs reachable from the seed sitemaps through indexes of any depth; indexes may point to each other."""
    edges = nested_sitemaps(sitemaps).select(F.col("index_url").alias("src"), F.col("url").alias("dst"))
    start = sitemaps.filter(F.col("url").isin(seeds)).select(F.col("url").alias("node"))
    reached = reachable(edges, start).select(F.col("node").alias("url"))
    return sitemap_urls(sitemaps.join(reached, "url", "left_semi"), alternate_links)
