"""Page-set operators: seeds, link graph, reachability, deduplication and caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrecords.functions.urls import (
    any_found,
    any_scheme_pattern,
    canonical,
    fingerprint,
    follow_allowed,
    in_domains,
    is_page_link,
    other_scheme,
    redirect_ok,
)
from docrecords.operators.prefix import running
from docrecords.operators.storage import checkpoint_dir
from docrecords.spec import Spec

BROADCAST_BYTES = 32 << 20


def seed_kinds(spec: Spec) -> list[tuple[str, str, bool]]:
    """Start of a run: ``(url, kind, scrape)``. ``only_urls`` alone when given, else sitemaps, then start URLs."""
    if spec.only_urls:
        return [(url, "page", spec.scrape_start_urls) for url in spec.only_urls]
    return [(url, "sitemap", False) for url in spec.sitemap_urls] + [
        (rule.url, "page", spec.scrape_start_urls) for rule in spec.start_urls
    ]


def seeds(spark: SparkSession, spec: Spec) -> DataFrame:
    rows = [(ix, *seed) for ix, seed in enumerate(seed_kinds(spec))]
    return spark.createDataFrame(rows, "ord int, url string, kind string, scrape boolean")


def allow_patterns(spec: Spec) -> list[str]:
    return list(spec.only_urls) or [any_scheme_pattern(rule.url) for rule in spec.start_urls]


def deny_patterns(spec: Spec) -> list[str]:
    return [any_scheme_pattern(url) for url in spec.stop_urls]


def followed_links(links: DataFrame, spec: Spec) -> DataFrame:
    """Links that are followed: allowed, not denied, on an allowed domain, in canonical form unless anchors matter."""
    keep = is_page_link(F.col("dst_url")) & follow_allowed(F.col("dst_url"), allow_patterns(spec), deny_patterns(spec))
    if spec.allowed_domains:
        keep = keep & in_domains(F.col("dst_url"), spec.allowed_domains)
    out = links.filter(keep)
    if spec.use_anchors and spec.js_render:
        return out
    return out.withColumn("dst_url", canonical(F.col("dst_url")))


def first_by(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """First row per key. Each task keeps only its own first rows before the shuffle, so no key can pile up."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def dedupe_requests(
    requests: DataFrame, order: Sequence[str] = ("ord",), url: str = "url", flagged: str | None = None,
    use_anchors: bool = False,
) -> DataFrame:
    """First request per URL whatever its scheme.

    ``flagged`` marks redirects and scheme fallbacks: those are compared with the scheme, so the same page may come
    again under the other scheme once. A plain request is kept if it is the first of its group; a flagged one if it is
    the first flagged one of its exact URL and no kept plain one came before it.
    """
    by = [F.col(c) for c in order]
    out = requests.withColumn("_fp", fingerprint(F.col(url), use_anchors=use_anchors))
    if flagged is None:
        return first_by(out, F.col("_fp"), by).drop("_fp")
    plain_first = first_by(out, F.col("_fp"), by).filter(~F.col(flagged))
    again = plain_first.unionByName(out.filter(F.col(flagged)))
    again = again.withColumn("_fps", fingerprint(F.col(url), with_scheme=True, use_anchors=use_anchors))
    return first_by(again, F.col("_fps"), by).drop("_fp", "_fps")


def not_seen(requests: DataFrame, seen: DataFrame, url: str = "url", use_anchors: bool = False) -> DataFrame:
    """Requests whose fingerprint is not in ``seen(fp)``."""
    out = requests.withColumn("fp", fingerprint(F.col(url), use_anchors=use_anchors))
    return out.join(seen.select("fp"), "fp", "left_anti").drop("fp")


def reachable(links: DataFrame, start: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Nodes reachable from ``start(node)`` over ``links(src, dst)``, with their distance.

    Semi-naive rounds: only the newest nodes are joined with the links. Every round is checkpointed, which keeps the
    plan flat and lets a lost executor's part be read again. The number of rounds is the depth of the graph. Links are
    dealt out by their source once and stored so; a round moves its newest nodes only, which are broadcast when their
    measured size is small.
    """
    spark = links.sparkSession
    checkpoint_dir(spark)
    links = links.select("src", "dst")
    if max_hops is None or max_hops > 1:
        links = links.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src").checkpoint()
    frontier = start.select("node").distinct().withColumn("hops", F.lit(0)).checkpoint()
    seen = frontier
    hops = 0
    while max_hops is None or hops < max_hops:
        size = frontier.agg(F.coalesce(F.sum(F.length(F.col("node").cast("string")) + 40), F.lit(0))).first()[0]
        if size == 0:
            break
        hops += 1
        newest = frontier.select(F.col("node").alias("src"))
        found = links.join(F.broadcast(newest) if size < BROADCAST_BYTES else newest, "src", "left_semi")
        found = found.select(F.col("dst").alias("node")).distinct()
        frontier = found.join(seen, "node", "left_anti").withColumn("hops", F.lit(hops)).checkpoint()
        seen = seen.unionByName(frontier).checkpoint() if hops % 8 == 0 else seen.unionByName(frontier)
    return seen


def crawl_closure(links: DataFrame, start: DataFrame, spec: Spec) -> DataFrame:
    """Pages reached from the start pages over followed links; one hop only when ``only_urls`` is set."""
    edges = followed_links(links, spec).select(
        canonical(F.col("src_url")).alias("src"), F.col("dst_url").alias("dst")
    )
    nodes = start.select(canonical(F.col("url")).alias("node"))
    return reachable(edges, nodes, max_hops=1 if spec.only_urls else None)


def with_fallback(wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    """Each seed with the response it got, or the one of the same URL under the other scheme after an error.

    ``wanted(url)``, ``fetched(url, status, ...)``. Adds ``fetched_url`` (null when both failed) and ``is_fallback``.
    """
    good = fetched.filter(F.col("status") < 400).select(F.col("url").alias("fetched_url")).distinct()
    tried = wanted.withColumn("_try", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("url").alias("u")),
                                                        F.struct(F.lit(1).alias("turn"), other_scheme(F.col("url")).alias("u")))))
    hit = tried.join(good, F.col("_try.u") == F.col("fetched_url"), "left")
    best = F.min(F.when(F.col("fetched_url").isNotNull(), F.struct("_try.turn", "fetched_url")))
    out = hit.groupBy(*wanted.columns).agg(best.alias("_best"))
    return out.select(
        *wanted.columns, F.col("_best.fetched_url").alias("fetched_url"), (F.col("_best.turn") == 1).alias("is_fallback")
    )


def record_pages(pages: DataFrame, spec: Spec) -> DataFrame:
    """Crawled pages that give records: rules hold for response and request, start pages only when wanted."""
    ok = redirect_ok(F.col("url"), F.col("request_url"), allow_patterns(spec), deny_patterns(spec), spec.strict_redirect)
    return drop_start_pages(pages.filter(ok), spec)


def drop_start_pages(pages: DataFrame, spec: Spec) -> DataFrame:
    if spec.scrape_start_urls:
        return pages
    start = [rule.url for rule in spec.start_urls]
    return pages.filter(~(F.col("url").isin(start) | F.col("request_url").isin(start)))


def sitemap_patterns(spec: Spec) -> list[str]:
    return list(spec.sitemap_urls_regexs) or [any_scheme_pattern(rule.url) for rule in spec.start_urls] or [".*"]


def sitemap_pages(pages: DataFrame, spec: Spec) -> DataFrame:
    """Sitemap pages that give records: any sitemap pattern, then the page rules unless forced."""
    out = pages.filter(any_found(F.col("url"), sitemap_patterns(spec)))
    return out if spec.force_sitemap_urls_crawling else record_pages(out, spec)


def page_set(
    from_sitemap: DataFrame, crawled: DataFrame, order: str = "page_id", flagged: str | None = None,
    use_anchors: bool = False,
) -> DataFrame:
    """All pages once, sitemap pages first; adds ``from_sitemap``."""
    both = from_sitemap.withColumn("from_sitemap", F.lit(True)).unionByName(
        crawled.withColumn("from_sitemap", F.lit(False))
    )
    out = both.withColumn("_late", (~F.col("from_sitemap")).cast("int"))
    out = dedupe_requests(out, ["_late", order], flagged=flagged, use_anchors=use_anchors)
    return out.drop("_late")


def cap_pages(per_page: DataFrame, cap: int, order: str = "page_id") -> DataFrame:
    """Pages up to the hit cap, in order of sitemap pages first, then ``order``; adds the ``before`` count.

    ``per_page(order, from_sitemap, records)``. The page that crosses the cap is kept, later ones are not; 0 means no
    cap. The running count goes over parts of the order, so no task sees all pages.
    """
    late = (~F.col("from_sitemap")).cast("int")
    counted = running(per_page, [], order, sums={"before": F.col("records")}, large=True, major=[late])
    return counted.filter(F.col("before") <= cap) if cap > 0 else counted


def cap_records(records: DataFrame, per_page: DataFrame, cap: int, key: str = "page_id") -> DataFrame:
    """Records of the pages that stay below the cap."""
    return records.join(cap_pages(per_page, cap, key).select(key), key, "left_semi") if cap > 0 else records
