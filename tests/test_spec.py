"""Parameters: defaults, checks and URL variables."""

import pytest

from docrecords import Spec
from docrecords.functions.urls import any_scheme_pattern, java_regex
from docrecords.operators.css import css_to_xpath, simple_compounds

BASE = {"index_uid": "t", "start_urls": ["http://www.foo.bar/"], "selectors": {"lvl0": "h1", "content": "p"}}


def spec(**kw):
    return Spec.of({**BASE, **kw})


@pytest.mark.parametrize(
    "bad",
    [
        {"index_uid": None},
        {"start_urls": None},
        {"start_urls": []},
        {"start_urls": "www.foo.bar"},
        {"stop_urls": "www.foo.bar"},
        {"custom_settings": ["x"]},
        {"js_render": "yes"},
        {"use_anchors": "yes"},
        {"js_wait": "1"},
        {"nb_hits_max": "1"},
        {"sitemap_alternate_links": "yes"},
        {"sitemap_urls_regexs": ["/doc/"]},
        {"force_sitemap_urls_crawling": True},
        {"scrape_start_urls": False, "scrap_start_urls": False},
        {"selectors": {"lvl0": {"selector": "h1", "type": "regex"}}},
        {"start_urls": [{"url": "http://a/(?P<v>.*?)/"}]},
        {"start_urls": [{"url": "http://a/(?P<v>.*?)/", "variables": {"v": {"url": "x", "js": "y"}}}]},
    ],
)
def test_rejected(bad):
    with pytest.raises(ValueError):
        spec(**bad)


def test_defaults():
    s = spec()
    assert s.start_urls[0].tags == () and s.start_urls[0].page_rank == 0 and s.start_urls[0].selectors_key == "default"
    assert s.start_urls[0].url == "http://www.foo.bar/"
    assert s.strip_chars == ".,;:§¶" and s.nb_hits_max == 0 and s.strict_redirect
    assert s.selectors_exclude == () and s.only_urls == () and s.scrape_start_urls
    assert spec(scrap_start_urls=False).scrape_start_urls is False
    assert Spec.of({"index_uid": "x", "sitemap_urls": ["http://a/s.xml"], "sitemap_urls_regexs": ["/d/"]}).start_urls == ()


def test_domains():
    assert spec().allowed_domains == ("www.foo.bar",)
    assert spec(stop_urls=["http://www.other.com/", "http://www.foo.bar/"]).allowed_domains == ("www.foo.bar", "www.other.com")
    assert spec(allowed_domains=["localhost"]).allowed_domains == ("localhost",)
    assert spec(start_urls=["http://localhost:8080/x"]).allowed_domains == ("localhost:8080",)


def test_variables():
    months = ["jan", "mar", "may", "jul", "sep", "nov"]
    rule = {"url": "http://garden.example/(?P<bed>.*?)/(?P<month>.*?).html", "variables": {"month": months, "bed": ["north", "south"]}}
    s = spec(start_urls=[rule, {"url": "http://shed.example/(?P<bed>.*?)/", "variables": {"bed": ["west"]}}])
    want = [f"http://garden.example/{bed}/{month}.html" for bed in ("north", "south") for month in months]
    assert [r.url for r in s.start_urls] == [*want, "http://shed.example/west/"]
    assert s.start_urls[7].url_attributes == {"bed": "south", "month": "mar"}
    assert s.facets() == ["bed", "month"]


def test_used_levels():
    def levels(**selectors):
        return spec(selectors={"default": selectors}).selectors["default"]

    s = levels(lvl0="h1", lvl2="h3", content="p", extra=".x")
    assert s.used_levels == ["lvl0", "content"] and s.heading_count == 1
    assert list(s.page_wide) == ["lvl2", "extra"] and s.extras == ["extra"]
    assert levels(lvl0="h1", text="p").used_levels == ["lvl0", "content"]
    assert levels(lvl0={"selector": "h1", "global": "true"}).page_wide.keys() == {"lvl0"}


def test_min_levels():
    s = spec(min_indexed_level={"default": 1, "api": 2})
    assert (s.min_level_for("api"), s.min_level_for("other")) == (2, 1)


def test_patterns():
    assert any_scheme_pattern("http://a.b/c") == any_scheme_pattern("https://a.b/c") == "^https?://a.b/c(.*)$"
    assert any_scheme_pattern("/docs/") == "/docs/"
    assert java_regex(r"/(?P<my_name>\d+)/(?P=my_name)\Z") == r"/(?<g0>\d+)/\k<g0>\z"


@pytest.mark.parametrize(
    "css, xpath",
    [
        ("h1", "descendant-or-self::h1"),
        ("H1", "descendant-or-self::h1"),
        ("main > p", "descendant-or-self::main/p"),
        ("#id b", 'descendant-or-self::*[@id = "id"]/descendant::b'),
        ("a, b", "descendant-or-self::a | descendant-or-self::b"),
        ("h1 + p", "descendant-or-self::h1/following-sibling::*[1]/self::p"),
        ("h1 ~ p", "descendant-or-self::h1/following-sibling::p"),
        ("[data-x]", "descendant-or-self::*[@data-x]"),
    ],
)
def test_css(css, xpath):
    assert css_to_xpath(css) == xpath


def test_css_errors():
    for css in ("h1:hover", "h1 >", "::before"):
        with pytest.raises(ValueError):
            css_to_xpath(css) if css != "h1 >" else simple_compounds("")
