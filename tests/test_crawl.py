"""Page sets: links, reachability, deduplication, sitemaps, whole runs."""

import random

import pytest
from pyspark.sql import functions as F

from docrecords import Spec
from docrecords.operators import crawl as C
from docrecords.plans import crawl as plan
from docrecords.plans.crawl import select_pages
from docrecords.sources.sitemap import crawl_sitemaps, nested_sitemaps, sitemap_urls


def spec(**kw):
    return Spec.of({"index_uid": "t", "start_urls": ["http://a.b/docs/"], "selectors": {"lvl0": "h1", "content": "p"}, **kw})


def test_reachable_on_a_cyclic_graph(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)] + [(i, i + 1) for i in range(100, 125)] + [(0, 100)]
    hops, frontier = {0: 0}, [0]
    while frontier:
        nxt = []
        for a, b in edges:
            if a in frontier and b not in hops:
                hops[b] = hops[a] + 1
                nxt.append(b)
        frontier = nxt
    links = spark.createDataFrame(edges, "src int, dst int").coalesce(1)
    start = spark.createDataFrame([(0,)], "node int")
    got = {r.node: r.hops for r in C.reachable(links, start).collect()}
    assert got == hops
    one = {r.node for r in C.reachable(links, start, max_hops=1).collect()}
    assert one == {n for n, h in hops.items() if h <= 1}


def replay(requests):
    """Requests one by one against two seen sets."""
    plain, exact, kept = set(), set(), []
    for ord_, url, flagged in requests:
        key, full = url.split("://")[1], url
        if flagged:
            if full in exact:
                continue
            exact.add(full)
            plain.add(key)
        else:
            if key in plain:
                continue
            plain.add(key)
            exact.add(full)
        kept.append(ord_)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_dedupe_equals_replay(spark, seed):
    rnd = random.Random(seed)
    reqs = [(i, f"{rnd.choice(['http', 'https'])}://a.b/{rnd.randrange(6)}", rnd.random() < 0.4) for i in range(40)]
    df = spark.createDataFrame(reqs, "ord int, url string, flagged boolean").coalesce(1)
    got = sorted(r.ord for r in C.dedupe_requests(df, flagged="flagged").collect())
    assert got == replay(reqs)
    plain = [(i, u, False) for i, u, _ in reqs]
    assert sorted(r.ord for r in C.dedupe_requests(df).collect()) == replay(plain)


def test_fallback(spark):
    wanted = spark.createDataFrame([("http://a/",), ("http://b/",), ("https://c/",), ("http://d/",)], "url string")
    fetched = spark.createDataFrame(
        [("http://a/", 200), ("https://a/", 200), ("http://b/", 404), ("https://b/", 200), ("https://c/", 500), ("http://c/", 301), ("http://d/", 404)],
        "url string, status int",
    )
    got = {r.url: (r.fetched_url, r.is_fallback) for r in C.with_fallback(wanted, fetched).collect()}
    assert got == {
        "http://a/": ("http://a/", False),
        "http://b/": ("https://b/", True),
        "https://c/": ("http://c/", True),
        "http://d/": (None, None),
    }


def sitemap(*urls, alternates=()):
    links = "".join(f'<xhtml:link rel="alternate" href="{u}"/>' for u in alternates)
    body = "".join(f"<url><loc> {u}\n</loc>{links}</url>" for u in urls)
    return f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">{body}</urlset>'


def test_sitemaps(spark):
    index = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>http://a.b/s1.xml</loc></sitemap></sitemapindex>'
    rows = [
        ("http://a.b/s1.xml", sitemap("http://a.b/docs/1", "http://a.b/docs/2", alternates=["http://a.b/de/1"])),
        ("http://a.b/index.xml", index),
        ("http://a.b/unused.xml", sitemap("http://a.b/docs/9")),
    ]
    maps = spark.createDataFrame(rows, "url string, xml string").coalesce(1)
    one = maps.filter(F.col("url") == "http://a.b/s1.xml")
    assert [r.url for r in sitemap_urls(one).orderBy("ord").collect()] == ["http://a.b/docs/1", "http://a.b/docs/2"]
    assert "http://a.b/de/1" in {r.url for r in sitemap_urls(one, alternate_links=True).collect()}
    assert [(r.index_url, r.url) for r in nested_sitemaps(maps).collect()] == [("http://a.b/index.xml", "http://a.b/s1.xml")]
    found = crawl_sitemaps(maps, ["http://a.b/index.xml"])
    assert {r.url for r in found.collect()} == {"http://a.b/docs/1", "http://a.b/docs/2"}


def test_sitemap_indexes_of_any_depth_and_in_circles(spark):
    def index(*urls):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"

    rows = [(f"http://a.b/{i}", index(f"http://a.b/{i + 1}", "http://a.b/0")) for i in range(4)]
    rows += [("http://a.b/4", sitemap("http://a.b/docs/1")), ("http://a.b/9", sitemap("http://a.b/docs/9"))]
    maps = spark.createDataFrame(rows, "url string, xml string").coalesce(1)
    assert [r.url for r in crawl_sitemaps(maps, ["http://a.b/0"]).collect()] == ["http://a.b/docs/1"]


def test_links_behind_redirects_and_parameters(spark):
    link = '<h1>{}</h1><a href="{}">x</a>'
    rows = [
        (1, "http://a.b/", "http://a.b/", link.format(1, "/old")),
        (2, "http://a.b/new/x", "http://a.b/old", link.format(2, "c?p=2")),
        (3, "http://a.b/new/c?p=2", "http://a.b/new/c?p=2", link.format(3, "?q=d")),
        (4, "http://a.b/new/c?q=d", "http://a.b/new/c?q=d", "<h1>4</h1>"),
        (5, "http://a.b/lost", "http://a.b/lost", "<h1>5</h1>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, request_url string, html string").coalesce(1)
    for drop in (False, True):
        spec = Spec.of(index_uid="t", start_urls=["http://a.b/"], selectors={"lvl0": "h1", "content": "p"}, remove_get_params=drop)
        got = sorted(r.page_id for r in select_pages(pages, spec).collect())
        assert got == ([1, 2, 3] if drop else [1, 2, 3, 4])


def test_broken_sitemaps_give_what_they_can(spark):
    xml = """<urlset><!-- <url><loc>http://a.b/no</loc></url> --><url><image:image><image:loc>http://a.b/i.png</image:loc>
    </image:image><loc><![CDATA[http://a.b/1?x=1&y=2]]></loc></url><s:url><s:loc>http://a.b/2?x=1&amp;y=2</s:loc></s:url>
    <url><loc>http://a.b/3</loc></url><url><loc>http://a.b/4"""
    maps = spark.createDataFrame([("http://a.b/s.xml", xml)], "url string, xml string").coalesce(1)
    got = [r.url for r in sitemap_urls(maps).orderBy("ord").collect()]
    assert got == ["http://a.b/1?x=1&y=2", "http://a.b/2?x=1&y=2", "http://a.b/3"]


def test_seeds(spark):
    s = spec(sitemap_urls=["http://a.b/s.xml"])
    assert [(r.url, r.kind, r.scrape) for r in C.seeds(spark, s).orderBy("ord").collect()] == [
        ("http://a.b/s.xml", "sitemap", False),
        ("http://a.b/docs/", "page", True),
    ]
    only = spec(only_urls=["http://a.b/x"], sitemap_urls=["http://a.b/s.xml"], scrape_start_urls=False)
    assert [(r.url, r.kind, r.scrape) for r in C.seeds(spark, only).collect()] == [("http://a.b/x", "page", False)]


PAGES = [
    (1, "http://a.b/docs/", '<h1>Start</h1><a href="one">1</a><a href="/docs/two?b=1&amp;a=2#x">2</a><a href="/other">o</a>'),
    (2, "http://a.b/docs/one", '<h1>One</h1><a href="https://a.b/docs/three">3</a><a href="/docs/secret">s</a>'),
    (3, "http://a.b/docs/two?a=2&b=1", "<h1>Two</h1><p>text</p>"),
    (4, "https://a.b/docs/three", "<h1>Three</h1>"),
    (5, "http://a.b/docs/secret", "<h1>Secret</h1>"),
    (6, "http://a.b/docs/alone", "<h1>Alone</h1>"),
    (7, "http://a.b/other", "<h1>Other</h1>"),
    (8, "http://a.b/docs/three", "<h1>Three again</h1>"),
]


def titles(spark, s, **kw):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    rows = plan.run(pages, s, **kw).filter("type = 'lvl0'").collect()
    return sorted(r.hierarchy.lvl0 for r in rows)


def test_whole_run(spark):
    assert titles(spark, spec(stop_urls=["secret"])) == ["One", "Start", "Three", "Two"]
    assert titles(spark, spec(stop_urls=["secret"], scrape_start_urls=False)) == ["One", "Three", "Two"]
    assert titles(spark, spec(only_urls=["http://a.b/docs/one"])) == ["One"]


def test_run_with_sitemap(spark):
    maps = spark.createDataFrame([("http://a.b/s.xml", sitemap("http://a.b/docs/alone", "http://a.b/other"))], "url string, xml string")
    base = dict(stop_urls=["secret", "/one", "two"], sitemap_urls=["http://a.b/s.xml"], sitemap_urls_regexs=["http://a.b/"])
    assert titles(spark, spec(**base), sitemaps=maps) == ["Alone", "Start"]
    forced = spec(**base, force_sitemap_urls_crawling=True)
    assert titles(spark, forced, sitemaps=maps) == ["Alone", "Other", "Start"]


def test_redirected_pages(spark):
    rows = [(1, "http://a.b/docs/x", "http://a.b/docs/y"), (2, "http://a.b/login", "http://a.b/docs/z"), (3, "http://a.b/docs/w#", "http://a.b/docs/w")]
    pages = spark.createDataFrame(rows, "page_id int, url string, request_url string").coalesce(1)
    cleaned = plan.clean_responses(pages, spec())
    assert {r.url for r in cleaned.filter("page_id = 3").collect()} == {"http://a.b/docs/w"}
    assert sorted(r.page_id for r in C.record_pages(cleaned, spec()).collect()) == [1, 3]
    assert sorted(r.page_id for r in C.record_pages(cleaned, spec(strict_redirect=False)).collect()) == [1, 2, 3]
    stripped = plan.clean_responses(pages.withColumn("url", F.concat("url", F.lit("?q=1"))), spec(remove_get_params=True))
    assert {r.url for r in stripped.filter("page_id = 1").collect()} == {"http://a.b/docs/x"}


def test_cap_in_a_run(spark):
    assert titles(spark, spec(stop_urls=["secret"], nb_hits_max=1)) == ["One", "Start"]
    assert titles(spark, spec(stop_urls=["secret"], nb_hits_max=0)) == ["One", "Start", "Three", "Two"]


def test_seed_answers_under_the_other_scheme(spark):
    rows = [
        (1, "http://a.b/docs/", "", 404),
        (2, "https://a.b/docs/", '<h1>Start</h1><a href="/docs/one">1</a><a href="/docs/gone">1</a>', 200),
        (3, "https://a.b/docs/one", "<h1>One</h1>", 200),
        (4, "https://a.b/docs/gone", "<h1>Gone</h1>", 404),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status int").coalesce(1)
    got = plan.run(pages, spec()).filter("type = 'lvl0'").collect()
    assert sorted(r.hierarchy.lvl0 for r in got) == ["One", "Start"]


def test_refreshed_index(spark):
    from docrecords.operators.index import index_docs

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    stored = index_docs(plan.run(pages, spec()))
    only = spec(only_urls=["http://a.b/docs/one"])
    changed = pages.withColumn("html", F.replace("html", F.lit("One"), F.lit("First")))
    docs = plan.refreshed_index(stored, plan.run(changed, only), only)
    names = sorted(r.hierarchy_lvl0 for r in docs.filter("type = 'lvl0'").collect())
    assert names == ["First", "Secret", "Start", "Three", "Two"]
