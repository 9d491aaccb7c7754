"""URL functions against the standard library and known values."""

import hashlib
import urllib.parse

import pytest
from pyspark.sql import functions as F

from docrecords import Spec
from docrecords.functions import urls as U
from docrecords.operators import page_attrs as P
from docrecords.operators import url_rules as R


def each(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("u"))).collect()]


def test_canonical(spark):
    pairs = {
        "http://www.Example.com/do?c=3&b=5&b=2&a=50": "http://www.example.com/do?a=50&b=2&b=5&c=3",
        "HTTP://a.b": "http://a.b/",
        "http://a.b/x#frag": "http://a.b/x",
        "http://a.b/x?#frag": "http://a.b/x",
        "http://a.b/résumé": "http://a.b/r%C3%A9sum%C3%A9",
        "http://a.b/r%c3%a9sum%c3%a9": "http://a.b/r%C3%A9sum%C3%A9",
        "http://a.b/a b": "http://a.b/a%20b",
        "http://a.b/a%2fb": "http://a.b/a%2Fb",
        "http://a.b/a+b": "http://a.b/a+b",
        "http://a.b/p?q=a b&x": "http://a.b/p?q=a+b&x=",
        "http://a.b/p?q=é": "http://a.b/p?q=%C3%A9",
        "http://a.b?q=1": "http://a.b/?q=1",
        "http://a.b/bad%zz": "http://a.b/bad%zz",
        "http://a.b/%41": "http://a.b/A",
    }
    assert each(spark, pairs, U.canonical) == list(pairs.values())


def test_fingerprint(spark):
    got = each(spark, ["http://a.b/x?b=1&a=2#f", "https://a.b/x?a=2&b=1"], U.fingerprint)
    assert got == [hashlib.sha1(b"GET://a.b/x?a=2&b=1").hexdigest()] * 2
    scheme = each(spark, ["http://a.b/", "https://a.b/"], lambda u: U.fingerprint(u, with_scheme=True))
    assert scheme[0] != scheme[1]
    anchor = each(spark, ["http://a.b/#x", "http://a.b/#y"], lambda u: U.fingerprint(u, use_anchors=True))
    assert anchor[0] != anchor[1]


def test_scheme_forms(spark):
    values = ["http://a.b/c", "https://a.b/c", None]
    assert each(spark, values, U.other_scheme) == ["https://a.b/c", "http://a.b/c", None]
    assert each(spark, ["http://a/x", "https://a/x", "/docs"], U.any_scheme) == ["^https?://a/x(.*)$"] * 2 + ["/docs"]
    with pytest.raises(Exception, match="no http"):
        each(spark, ["ftp://a.b/"], U.other_scheme)


def test_parts(spark):
    values = ["http://u:p@a.b:80/x;p?q#f", "https://test.com/doc/(?P<v>.*?)/", "no url"]
    assert each(spark, values, U.netloc) == [urllib.parse.urlparse(v).netloc for v in values]
    assert each(spark, values[:1], U.hostname) == ["a.b"]
    assert each(spark, values[:1], U.drop_params) == ["http://u:p@a.b:80/x"]
    assert each(spark, values, U.variable_names) == [[], ["v"], []]


def test_resolve_like_the_standard_library(spark):
    base = "http://a.b/c/d/page.html?x=1#top"
    links = ["e", "/e", "//h.i/j", "?y=2", "#z", "../e", "./e", "../../../e", "http://x.y/z", "mailto:a@b", "e/./f/../g", "", "g/..", "g/."]
    for page in (base, "http://a.b", "http://a.b/"):
        got = each(spark, links, lambda u: U.resolve_link(u, F.lit(page)))
        assert got[:4] == [urllib.parse.urljoin(page, x) if page != "http://a.b" or x != "?y=2" else "http://a.b?y=2" for x in links[:4]]
        for link, url in zip(links, got):
            want = urllib.parse.urljoin(page, link)
            if link not in ("", "#z"):
                assert url == want, (page, link)
    assert each(spark, ["", "#z"], lambda u: U.resolve_link(u, F.lit(base))) == [base.split("#")[0], base.split("#")[0] + "#z"]


def test_domains_and_rules(spark):
    values = ["http://a.com/x", "http://www.a.com/", "http://ba.com/", "http://a.com.evil.org/", "http://A.com:80/"]
    assert each(spark, values, lambda u: U.in_domains(u, ["a.com"])) == [True, True, False, False, True]
    allow, deny = ["/docs/", "blog"], ["private"]
    values = ["http://a/docs/x", "http://a/blog", "http://a/docs/private", "http://a/"]
    assert each(spark, values, lambda u: U.follow_allowed(u, allow, deny)) == [True, True, False, False]
    assert each(spark, values, lambda u: U.redirect_ok(u, F.lit("http://a/blog"), allow, deny)) == [True, True, False, False]
    assert each(spark, values, lambda u: U.redirect_ok(u, F.lit("http://a/blog"), allow, deny, False)) == [True] * 4
    assert each(spark, ["http://a/x#", "http://a/x#y"], lambda u: U.drop_bare_fragment(u, F.lit("http://a/x"))) == ["http://a/x", "http://a/x#y"]


def test_first_rule_for_search_and_match(spark):
    rules = Spec.of(
        index_uid="t",
        start_urls=[
            {"url": "/b", "selectors_key": "inner", "page_rank": 7},
            {"url": "http://a", "selectors_key": "outer", "page_rank": 3, "tags": ["x", "y"]},
            {"url": "http://", "page_rank": 1, "extra_attributes": {"k": [1]}},
        ],
    ).start_urls
    values = ["http://a/b", "http://c", "ftp://a", None]
    assert each(spark, values, lambda u: P.selector_key(u, rules)) == ["inner", "default", "default", "default"]
    assert each(spark, values, lambda u: P.page_rank(u, rules)) == [3, 1, 0, 0]
    assert each(spark, values, lambda u: P.page_tags(u, rules)) == [["x", "y"], [], [], []]
    assert each(spark, values, lambda u: P.extra_attributes(u, rules)) == [{"k": "[1]"}] * 2 + [{}] * 2


def test_url_variables_fold(spark):
    rules = Spec.of(
        index_uid="t",
        start_urls=[
            {"url": "/(?P<lang>.*?)/", "variables": {"lang": ["en", "fr"]}},
            {"url": "/doc-(?P<v>.*?)$", "variables": {"v": ["1", "2"]}},
        ],
    ).start_urls
    got = each(spark, ["http://a/en/x/doc-2", "http://a/de/doc-1", "http://a/"], lambda u: P.url_variables(u, rules))
    assert [(r.url, r.vars) for r in got] == [
        ("http://a//x/doc-", {"lang": '"en"', "v": '"2"'}),
        ("http://a/de/doc-", {"v": '"1"'}),
        ("http://a/", {}),
    ]


def test_rule_tables(spark):
    rules = spark.createDataFrame(
        [
            (0, "https://t/(?P<v>.*?)/(?P<k>.*?)/", {"v": ["1.0", "1.1"], "k": ["a", "b", "c"]}, None),
            (1, "https://t/plain", None, 5),
        ],
        "ord int, url string, variables map<string, array<string>>, page_rank int",
    )
    out = R.expand_variables(R.normalise_rules(rules)).orderBy("ord", "path").collect()
    assert [r.url for r in out] == [f"https://t/{v}/{k}/" for v in ("1.0", "1.1") for k in "abc"] + ["https://t/plain"]
    assert out[0].url_attributes == {"v": "1.0", "k": "a"} and out[0].page_rank == 0 and out[6].page_rank == 5
    assert {r.facet for r in R.facet_names(R.expand_variables(rules)).collect()} == {"v", "k"}
    missing = spark.createDataFrame([(0, "http://t/(?P<v>.*?)/", {"w": ["1"]})], "ord int, url string, variables map<string, array<string>>")
    with pytest.raises(Exception, match="missing values"):
        R.expand_variables(missing).collect()
    names = [f"n{i}" for i in range(10)]
    url = "https://t/" + "/".join(f"(?P<{n}>.*?)" for n in names)
    many = spark.createDataFrame([(0, url, {n: ["a", "b"] if i < 2 else [n] for i, n in enumerate(names)})], "ord int, url string, variables map<string, array<string>>")
    out = R.expand_variables(many).orderBy("path").collect()
    assert [r.url for r in out] == [f"https://t/{x}/{y}/" + "/".join(names[2:]) for x in "ab" for y in "ab"]
    urls = spark.createDataFrame([(0, "http://b.c/"), (1, "http://a.b/"), (2, "http://b.c/x")], "ord int, url string")
    assert [r.domain for r in R.allowed_domains(urls).orderBy("ord").collect()] == ["b.c", "a.b"]
